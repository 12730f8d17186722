"""Aggregations of a probe design: specificity, coverage, consolidation, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luminode.operators.joins import RANKS


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def abundance(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Count and relative abundance of each category within keys."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def probe_summary(hits: DataFrame, abundance: DataFrame, min_homology: int, probe: str = "probe_id", rank: str = "genus") -> DataFrame:
    """Specificity of each probe from its hits.

    hits: probe, mch, length, qcovhsp, evalue, bitscore, tm, gc, target_hit, full_hit, full_match;
    abundance: probe, abundance. Rates run over hits with mch or length >= min_homology (0 where
    there is none), the off-target extremes over hits with mch below it (e-value 100, else 0).
    The full match covers all hits, for strains the filtered ones.
    """
    hit = (F.col("mch") >= min_homology) | (F.col("length") >= min_homology)
    below = F.col("mch") < min_homology
    target = "full_hit" if rank == "strain" else "target_hit"
    matched = (hit & F.col("full_match")) if rank == "strain" else (F.col("full_match") & F.lit(True))
    n = F.sum(hit.cast("long"))
    none = lambda c, otherwise=0.0: F.coalesce(c, F.lit(otherwise))
    highest = F.max(F.when(below, F.struct("mch", "qcovhsp")))
    out = hits.groupBy(probe).agg(
        n.alias("n_hits"),
        none(F.avg(F.when(hit, F.col(target).cast("double")))).alias("on_target_rate"),
        none(F.avg(F.when(hit, F.col("full_hit").cast("double")))).alias("on_target_full_rate"),
        F.sum((hit & F.col("full_hit")).cast("long")).alias("full_hits"),
        F.sum(matched.cast("long")).alias("full_matches"),
        none(F.min(F.when(below, F.col("evalue"))), 100.0).alias("off_target_min_evalue"),
        none(F.max(F.when(below, F.col("bitscore")))).alias("off_target_max_bitscore"),
        none(highest["mch"], 0).alias("off_target_max_mch"),
        none(highest["qcovhsp"]).alias("off_target_max_mch_qcovhsp"),
        none(F.avg(F.when(below, (F.col("qcovhsp") > 99.9).cast("double")))).alias("off_target_full_qcovhsp_fraction"),
        none(F.max(F.when(below, F.col("tm")))).alias("off_target_max_tm"),
        none(F.max(F.when(below, F.col("gc"))), 0).alias("off_target_max_gc"),
    )
    joined = out.join(abundance, probe, "left")
    some = F.col("n_hits") > 0
    full = F.col("full_matches") if rank == "strain" else F.when(some, F.col("full_matches")).otherwise(0)
    return joined.withColumns({"taxon_coverage": F.col("full_hits") / F.col("abundance"), "on_target_full_match": full / F.col("abundance")}).drop("n_hits", "full_hits", "full_matches")


def target_abundance(members: DataFrame, key: str) -> DataFrame:
    return members.groupBy(key).agg(F.count("*").alias("abundance"))


def offtarget_ranks(ranked: DataFrame, probe: str, rank: str, target_hit: str, ranks: tuple[str, ...] = (*RANKS, "no rank")) -> DataFrame:
    """Share of a probe's off-target rows at each common rank: 0 for a probe all on target, null for one without rows."""
    off = ~F.col(target_hit)
    return ranked.groupBy(probe).agg(*[F.coalesce(F.avg(F.when(off, (F.col(rank) == r).cast("double"))), F.when(F.count(target_hit) > 0, 0.0)).alias(r.replace(" ", "_")) for r in ranks])


def consolidate(candidates: DataFrame, seq: str, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """For each shared sequence the deepest rank at which it is still unique (level), deeper ranks null.

    level = number of ranks less those with several values; a null counts as a value of its own.
    """
    several = [F.when(F.count_distinct(F.coalesce(F.col(r).cast("string"), F.lit(""))) > 1, 1).otherwise(0).alias(f"__{r}") for r in ranks]
    grouped = candidates.groupBy(seq).agg(F.count("*").alias("n"), *several, *[F.min(r).alias(r) for r in ranks])
    level = F.lit(len(ranks)) - sum((F.col(f"__{r}") for r in ranks[1:]), F.col(f"__{ranks[0]}"))
    grouped = grouped.withColumn("level", level)
    return grouped.select(seq, "n", "level", *[F.when(F.col("level") > k, F.col(r)).alias(r) for k, r in enumerate(ranks)])


def by_level(df: DataFrame, level: str = "level", levels: int = 8) -> DataFrame:
    """Each row once for every level (0 to levels - 1) up to its own, as column at_level."""
    return df.withColumn("at_level", F.explode(F.sequence(F.lit(0), F.least(F.col(level), F.lit(levels - 1)))))


def union_coverage(hits: DataFrame, probes: DataFrame, abundance: DataFrame, taxon: str = "taxon") -> DataFrame:
    """Share of a taxon's molecules that any chosen probe covers."""
    covered = hits.join(probes, [taxon, "probe_id"], "left_semi").groupBy(taxon).agg(F.count_distinct("molecule_id").alias("covered"))
    return abundance.join(covered, taxon, "left").select(taxon, (F.coalesce("covered", F.lit(0)) / F.col("abundance")).alias("coverage"))


def cover(hits: DataFrame, min_homology: int, min_qcov: float | None = None) -> DataFrame:
    """Distinct (molecule, probe) pairs that count as covered."""
    kept = hits.where(F.col("mch") >= min_homology)
    return (kept if min_qcov is None else kept.where(F.col("qcovhsp") >= min_qcov)).select("molecule_id", "probe_id").distinct()


def detectability(coverage: DataFrame) -> DataFrame:
    """One row: molecules, mean over them of their best coverage, share of them with any."""
    best = coverage.groupBy("molecule_id").agg(F.max("coverage").alias("best"))
    return best.agg(F.count("*").alias("molecules"), F.avg("best").alias("mean_coverage"), share(F.col("best") > 0).alias("detectable"))


def diversity(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Richness, Shannon index, inverse Simpson index and Gini coefficient of counts within keys.

    Gini: values moved up where any is negative, 1e-7 added, then the rank-weighted sum.
    """
    w = Window.partitionBy(*keys)
    p = counts.withColumn("__p", F.col(n) / F.sum(n).over(w))
    p = p.withColumn("__v", F.col(n) - F.least(F.min(n).over(w), F.lit(0)) + F.lit(1e-7)).withColumn("__i", F.row_number().over(w.orderBy("__v")))
    plogp = F.when(F.col("__p") > 0, F.col("__p") * F.log("__p")).otherwise(0.0)
    size = F.count("*")
    gini = F.sum((2 * F.col("__i")) * F.col("__v")) / (size * F.sum("__v")) - (size + 1) / size
    return p.groupBy(*keys).agg(F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).alias("richness"), (-F.sum(plogp)).alias("shannon"), (1 / F.sum(F.col("__p") * F.col("__p"))).alias("inverse_simpson"), gini.alias("gini"))


def richness_fraction(counts: DataFrame, keys: list[str], category: str, n: str = "n") -> DataFrame:
    """Categories met within keys over all categories that any key has."""
    met = counts.where(F.col(n) > 0)
    whole = F.broadcast(met.agg(F.count_distinct(category).alias("__all")))
    return met.groupBy(*keys).agg(F.count_distinct(category).alias("__own")).crossJoin(whole).select(*keys, (F.col("__own") / F.col("__all")).alias("richness_fraction"))


def value_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, mean and sample deviation of a value (signal to noise, intensity) per class."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def rollup_counts(df: DataFrame, ranks: list[str]) -> DataFrame:
    """Rows at each rank and under each higher one, from the highest down; null stands for all."""
    return df.rollup(*ranks).agg(F.count("*").alias("n"))


def sample_quality(cells: DataFrame, sample: str, category: str) -> DataFrame:
    """Cells and classes of each sample."""
    return cells.groupBy(sample).agg(F.count("*").alias("cells"), F.count_distinct(category).alias("classes"))


def compare_sources(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("imaging", "sequencing")) -> DataFrame:
    """Rows per key in two sources; keys of the first, 0 where the second has none."""
    of = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    return of(a, names[0]).join(of(b, names[1]), key, "left").na.fill(0, [names[1]])


def pool_report(pool: DataFrame, kept: Column, encoding: Column) -> DataFrame:
    """Oligos, encoding oligos and their share, before and after a filter."""
    return pool.agg(F.count("*").alias("n"), F.sum(encoding.cast("long")).alias("n_encoding"), share(encoding).alias("encoding_fraction"), F.sum(kept.cast("long")).alias("n_kept"), F.sum((kept & encoding).cast("long")).alias("n_kept_encoding"))


def probes_per_taxon(df: DataFrame, taxon: str, rate: str, min_rate: float) -> DataFrame:
    return df.where(F.col(rate) > min_rate).groupBy(taxon).agg(F.count("*").alias("n_probes"))


def final_check(hits: DataFrame, min_homology: int, window_start: int, window_length: int) -> DataFrame:
    """Share of a probe's hits (mch >= min_homology) on target or inside the target window; 0 where none is left."""
    inside = (F.col("start") >= window_start) & (F.col("start") < window_start + window_length)
    ok = F.when(F.col("mch") >= min_homology, (F.col("target_hit") | inside).cast("double"))
    return hits.groupBy("probe_id").agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("checked"))


def plurality(df: DataFrame, taxon: str, id: str) -> DataFrame:
    """Distinct non-zero ids of each taxon, and the taxon's share of all rows."""
    counts = df.groupBy(taxon).agg(F.count_distinct(F.when(F.col(id) != 0, F.col(id))).alias("plurality"), F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(taxon, "plurality", (F.col("n") / F.col("total")).alias("fraction"))


def offtarget_gc(hits: DataFrame, target: str, off_target: str, gc: str) -> DataFrame:
    return hits.groupBy(target, off_target).agg(F.max(gc).alias("max_gc"))
