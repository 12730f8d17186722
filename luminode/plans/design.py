"""The design flow: candidate windows, seed hits, specificity, best probe per position bin, as a design's parameters say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import joins as J
from luminode.operators import probes, selection, summaries
from luminode.plans.base import dna, documents, query, rnd, table
from luminode.sources import files
from luminode.sources.shared import new_path, stored

#: Parameters of the registered flow, a row of the design table; what it leaves out is null.
DEFAULT = {
    "design_id": "default",
    "max_continuous_homology": 18,
    "min_tm": 56.0,
    "max_tm": 64.0,
    "gc": 9.0,
    "probe_selection_method": "best_per_bin",
    "tpn": 5,
    "bot": 0.0,
    "bitscore_thresh": 30.0,
}
#: Width of a position bin, and letters of a seed.
BIN, SEED = 100, 14


def write_design(spark: SparkSession, path: str, *designs: dict) -> None:
    names = files.schema_of(files.DESIGN).names
    rows = [tuple(None if d.get(n) is None else str(d[n]) for n in names) for d in designs]
    spark.createDataFrame(rows, ", ".join(f"{n} STRING" for n in names)).coalesce(1).write.option("header", True).csv(path)


def chosen_probes(scored: DataFrame, design: Row) -> DataFrame:
    """The probes that the design's selection method takes of each taxon; selection_method tells a fallback.

    best_per_bin, all_specific, top_n (tpn of them) and single_best; a taxon without a specific
    probe has its single best one.
    """
    order = [F.desc("on_target_rate"), F.desc("taxon_coverage"), F.asc("off_target_max_mch"), F.asc("quality"), F.asc("probe_id")]
    specific = (F.col("on_target_rate") > design.bot) & (F.col("off_target_max_bitscore") < design.bitscore_thresh) & (F.col("off_target_max_mch") < design.max_continuous_homology)
    binned = scored.withColumn("bin", S.position_bin("p_start", BIN))
    method = design.probe_selection_method
    if method == "best_per_bin":
        return selection.with_fallback(binned, specific, "taxon", order, order, "bin", ("bins", "single"))
    if method == "all_specific":
        out = selection.all_specific(binned, specific, "taxon", order)
    elif method == "top_n":
        out = selection.top_n(binned, specific, "taxon", order, design.tpn)
    elif method == "single_best":
        out = selection.first_of(binned, ["taxon"], order)
    else:
        raise ValueError(f"unknown selection method {method}")
    return out.withColumn("selection_method", F.when(specific, method).otherwise("single"))


def design_probes(targets: DataFrame, molecules: DataFrame, design: Row, sizes: tuple[int, ...] = (18, 19, 20, 21, 22, 23)) -> DataFrame:
    """The chosen probes of each taxon. targets: taxon, seq; molecules: molecule_id, seq, lang (their group).

    Candidates are windows within the design's melting temperatures and GC count; hits are ungapped
    seed hits on all molecules; a hit is on target where the molecule's group is that of most hits
    of its taxon (the larger name of equally frequent ones).
    """
    found = probes.candidates(targets, "taxon", "seq", sizes=sizes, min_tm=design.min_tm, max_tm=design.max_tm, min_gc=design.gc)
    found = found.withColumn("probe_id", F.concat_ws("_", F.col("taxon").cast("string"), F.col("p_start").cast("string"), F.col("ln").cast("string")))
    found = stored(found, "candidates")
    hits = J.seed_hits(found.select("probe_id", "seq"), molecules.select("molecule_id", "seq"), SEED)
    hits = J.join_lineage(hits, molecules.select("molecule_id", "lang"), "molecule_id")
    hits = stored(hits.join(found.select("probe_id", "taxon", "gc", "tm"), "probe_id"), "hits")
    main = hits.groupBy("taxon", "lang").agg(F.count("*").alias("n")).groupBy("taxon").agg(F.max(F.struct("n", "lang")).alias("m")).select("taxon", F.col("m.lang").alias("main"))
    hits = hits.join(main, "taxon").withColumns({"target_hit": F.col("lang") == F.col("main"), "qcovhsp": 100.0 * F.col("run") / F.col("length"), "evalue": F.lit(1.0), "bitscore": 2.0 * F.col("run")})
    homology = design.max_continuous_homology
    hits = hits.withColumns({"full_hit": F.col("target_hit") & (F.col("mch") >= homology), "full_match": F.col("target_hit") & (F.col("mch") == F.col("length"))})
    sizes_ = summaries.target_abundance(hits, "probe_id")
    scored = J.attach(found, summaries.probe_summary(hits, sizes_, homology), "probe_id").na.fill(0)
    return chosen_probes(scored, design)


@query()
def best_probes(spark: SparkSession, sf_dir: str, **parameters) -> DataFrame:
    """For each benchmark item the probes that a design takes, judged against all documents.

    The design is a row of a design table, looked up by its id; keyword arguments replace its parameters.
    """
    path = new_path(spark, "designs")
    write_design(spark, path, DEFAULT | parameters)
    design = files.design_parameters(files.read_designs(spark, path), (DEFAULT | parameters)["design_id"]).first()
    targets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("taxon"), dna("text").alias("seq"))
    # of rows that repeat an id the least text counts, and the language that goes with it
    docs = documents(spark, sf_dir).groupBy(F.col("doc_id").alias("molecule_id")).agg(F.min(F.struct(dna("text").alias("seq"), "lang")).alias("d")).select("molecule_id", "d.seq", "d.lang")
    best = design_probes(targets, stored(docs, "molecules"), design)
    return best.select("taxon", "bin", "probe_id", rnd("tm").alias("tm"), "gc", rnd("on_target_rate").alias("on_target_rate"), "selection_method")
