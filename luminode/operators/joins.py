"""Joins: lineage, ranges, nearest rows, neighbours in space, k-mer seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import seeds
from luminode.operators.scans import nearest_flagged  # noqa: F401
from luminode.operators.tiles import CellTree
from luminode.sources.shared import stored

#: Positions that meet in one bucket of an overlap join.
BUCKET = 64
#: Cells of a square that one task compares with their neighbours.
CROWD = 2000
#: Letters of the longest probe up to which a seed carries what lies around it.
NEAR = 64
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")


def join_lineage(hits: DataFrame, lineage: DataFrame, key: str = "molecule_id") -> DataFrame:
    """Hits with the ranks of their molecule; hits without lineage stay, with nulls."""
    return hits.join(lineage, key, "left")


def cluster_names(lineage: DataFrame, taxon: str, cluster: str) -> DataFrame:
    """A label for every (taxon, cluster): the taxon where it has one sequence or one cluster, else taxon_ClusterN."""
    w = Window.partitionBy(taxon)
    counted = lineage.groupBy(taxon, cluster).agg(F.count("*").alias("n_sequences"))
    counted = counted.withColumns({"taxon_sequences": F.sum("n_sequences").over(w), "taxon_clusters": F.count("*").over(w)})
    single = (F.col("taxon_sequences") == 1) | (F.col("taxon_clusters") == 1)
    name = F.when(single, F.col(taxon).cast("string")).otherwise(F.concat(F.col(taxon).cast("string"), F.lit("_Cluster"), F.col(cluster).cast("string")))
    return counted.select(taxon, cluster, name.alias("target"), "n_sequences")


def join_cluster(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(names, keys, "inner")


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Summaries (left join) or flank variants (right join) of probes."""
    return left.join(right, key, how)


def outer_counts(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts of two samples side by side; what one of them lacks is 0."""
    both = a.select(key, F.col(n).alias("n_1")).join(b.select(key, F.col(n).alias("n_2")), key, "outer")
    return both.select(key, F.coalesce("n_1", F.lit(0)).alias("n_1"), F.coalesce("n_2", F.lit(0)).alias("n_2"))


def drop_problem(probes: DataFrame, problems: DataFrame, taxon: str, probe: str, mode: str = "exact") -> DataFrame:
    """Probes that are no problem. compat drops a probe whose taxon and whose id each occur among problems, even apart."""
    if mode == "exact":
        return probes.join(problems, [taxon, probe], "left_anti")
    taxa = problems.select(taxon).distinct().withColumn("__taxon", F.lit(True))
    ids = problems.select(probe).distinct().withColumn("__id", F.lit(True))
    marked = probes.join(taxa, taxon, "left").join(ids, probe, "left")
    return marked.where(F.col("__taxon").isNull() | F.col("__id").isNull()).drop("__taxon", "__id")


def keep_edges(edges: DataFrame, kept: DataFrame, image: str = "image_id", label: str = "label", a: str = "label_1", b: str = "label_2") -> DataFrame:
    """Edges whose both ends are kept cells."""
    ends = [kept.select(image, F.col(label).alias(e)) for e in (a, b)]
    return edges.join(ends[0], [image, a], "left_semi").join(ends[1], [image, b], "left_semi")


def helpers(best: DataFrame, candidates: DataFrame, taxon: str = "taxon", reach: int = 100, gap: int = 3, group: int = 20) -> DataFrame:
    """Candidates beside a chosen probe of their taxon: at most `reach` bases away, at least `gap` between.

    best: taxon, source_id, start, end; candidates: taxon, helper_id, start, end. Positions meet by
    buckets as wide as the reach, so that a candidate is compared with near probes only.
    helper_group is (start - source start) / group, cut towards zero.
    """
    width = reach + gap
    b = best.select(taxon, "source_id", F.col("start").alias("s"), F.col("end").alias("e"))
    low, high = F.floor((F.col("s") - width) / width), F.floor((F.col("e") + width) / width)
    b = b.withColumn("bucket", F.explode(F.sequence(low, high)))
    # a candidate meets a probe in the bucket of its start only: once
    c = candidates.withColumn("bucket", F.floor(F.col("start") / width))
    five = (F.col("start") > F.col("s") - width) & (F.col("end") < F.col("s") - gap)
    three = (F.col("start") > F.col("e") + gap) & (F.col("end") < F.col("e") + width)
    joined = b.join(c, [taxon, "bucket"]).where(five | three)
    side = F.when(five, "5").otherwise("3")
    return joined.select(taxon, "source_id", "helper_id", "start", "end", side.alias("side"), ((F.col("start") - F.col("s")) / group).cast("int").alias("helper_group"))


def interference(hits: DataFrame, probes: DataFrame, key: str = "taxon", thresholds: tuple[int, ...] = (0, 5, 10)) -> DataFrame:
    """How much blocking hits overlap the places of encoding probes.

    hits: key, blocker_id, hit_start, hit_end on the minus strand (start > end); probes: key,
    p_start, ln. For a blocker and probe: share of its distinct hits that overlap by more than each
    threshold; averaged over probes, then the largest over keys.
    """
    if min(thresholds) < 0:
        raise ValueError("thresholds below 0 would count pairs that do not overlap")
    h = hits.select(key, "blocker_id", "hit_start", "hit_end").distinct()
    p = probes.select(key, "p_start", "ln").distinct()
    # overlapping pairs meet in the buckets that both cover, and count in the first of them
    inside = lambda low, high: F.explode(F.sequence(F.floor(low / BUCKET), F.floor(high / BUCKET)))
    left = h.withColumn("bucket", inside(F.least("hit_end", "hit_start"), F.greatest("hit_end", "hit_start")))
    right = p.where("ln > 0").withColumn("bucket", inside(F.col("p_start"), F.col("p_start") + F.col("ln")))
    overlap = F.least("hit_start", F.col("p_start") + F.col("ln")) - F.greatest("hit_end", F.col("p_start"))
    met = left.join(right, [key, "bucket"]).where(F.col("bucket") == F.floor(F.greatest("hit_end", "p_start") / BUCKET)).withColumn("overlap", overlap)
    pairs = met.groupBy(key, "blocker_id").agg(*[F.count(F.when(F.col("overlap") > t, 1)).alias(f"o{t}") for t in thresholds])
    # pairs that do not overlap only count below the line
    all_pairs = h.groupBy(key, "blocker_id").agg(F.count("*").alias("hits")).join(p.groupBy(key).agg(F.count("*").alias("probes")), key)
    mean = all_pairs.join(pairs, [key, "blocker_id"], "left")
    share = lambda t: F.coalesce(f"o{t}", F.lit(0)) / (F.col("hits") * F.col("probes"))
    return mean.groupBy("blocker_id").agg(*[F.max(share(t)).alias(f"over_{t}") for t in thresholds])


def interference_by_molecule(hits: DataFrame, probes: DataFrame, min_qcov: float = 99.9, thresholds: tuple[int, ...] = (0, 5, 10)) -> DataFrame:
    """interference by molecule; encoding hits count where they cover the probe and match without a break."""
    full = probes.where((F.col("qcovhsp") >= min_qcov) & (F.col("mch") == F.col("length")))
    return interference(hits, full, "molecule_id", thresholds)


def _grid(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    return df.withColumns({"gx": F.floor(F.col(x) / size), "gy": F.floor(F.col(y) / size)})


def pairs_within(cells: DataFrame, radius: float, keys: tuple[str, ...] = ("image_id", "code"), id: str = "cell", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (id_1 < id_2) with equal keys at most `radius` apart, and their distance.

    Cells meet by squares as wide as the radius and the eight around them. The cells of a square
    with more than CROWD are dealt to several tasks, to each of which their neighbours come.
    """
    a = _grid(cells, radius, x, y).select(*keys, F.col(id).alias("id_1"), F.col(x).alias("x_1"), F.col(y).alias("y_1"), "gx", "gy")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = a.select(*keys, F.col("id_1").alias("id_2"), F.col("x_1").alias("x_2"), F.col("y_1").alias("y_2"), "gx", "gy", near.alias("n"))
    b = b.withColumns({"gx": F.col("gx") + F.col("n.i"), "gy": F.col("gy") + F.col("n.j")}).drop("n")
    square = [*keys, "gx", "gy"]
    crowded = a.groupBy(*square).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*square, F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    crowded = stored(crowded, "crowded")
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(crowded, square, "left").withColumn("part", F.pmod(F.xxhash64("id_1"), parts).cast("int")).drop("parts")
    b = b.join(crowded, square, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    distance = F.sqrt((F.col("x_1") - F.col("x_2")) * (F.col("x_1") - F.col("x_2")) + (F.col("y_1") - F.col("y_2")) * (F.col("y_1") - F.col("y_2")))
    joined = a.join(b, [*square, "part"]).where("id_1 < id_2").withColumn("distance", distance)
    return joined.where(F.col("distance") <= radius).select(*keys, "id_1", "id_2", "x_1", "y_1", "x_2", "y_2", "distance")


def knn_points(points: DataFrame, cells: DataFrame, k: int, image: str = "image_id", id: str = "cell") -> DataFrame:
    """The k cells of a point's image nearest to it, ranked from 1; ties by id; all where there are fewer.

    points: image, point_id, px, py; cells: image, id, x, y. Each image has a tree of squares of its
    own, which goes as deep as its cells are dense; points and cells without a finite place are left out.
    """
    return CellTree(cells, image).nearest(points, k, id)


def min_distance(cells: DataFrame, boundary: DataFrame, image: str = "image_id", id: str = "cell") -> DataFrame:
    """Distance of every cell to the nearest boundary point (bx, by) of its image."""
    asked = cells.select(image, F.col(id).alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    edge = boundary.select(image, F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(0).alias("__edge")).distinct()
    near = knn_points(asked, edge, 1, image, "__edge")
    return near.groupBy(image, F.col("point_id").alias(id)).agg(F.min("distance").alias("distance"))


def adjacency(pixels: DataFrame, image: str = "image_id", both: bool = True) -> DataFrame:
    """Pairs of labels with touching pixels (eight neighbours), in both directions unless both is off."""
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    a = pixels.select(image, "x", "y", F.col("label").alias("label_1"))
    b = pixels.select(image, "x", "y", F.col("label").alias("label_2"), half.alias("n")).withColumns({"x": F.col("x") - F.col("n.i"), "y": F.col("y") - F.col("n.j")}).drop("n")
    touching = a.join(b, [image, "x", "y"]).where("label_1 <> label_2")
    low = touching.select(image, F.least("label_1", "label_2").alias("label_1"), F.greatest("label_1", "label_2").alias("label_2")).distinct()
    return low.union(low.select(image, F.col("label_2").alias("label_1"), F.col("label_1").alias("label_2"))) if both else low


def nn_classify(cells: DataFrame, reference: DataFrame, metric, id: str, block: tuple[str, ...] = ("flags",), code: str = "code") -> DataFrame:
    """The code of the nearest reference spectrum and its distance, a row per cell (and replicate).

    metric(v, ref_v) builds the distance column; only references with equal block columns are
    compared, all others are at distance 1. A cell that has none in its block so takes the smallest
    code (of the replicate) at distance 1. Ties go to the smallest code. This form compares a cell with
    its whole block; spectral_index does with less where references are many.
    """
    keys = [id, *[c for c in ("replicate",) if c in reference.columns]]
    joined = cells.join(reference, list(block)).withColumn("__d", metric(F.col("v"), F.col("ref_v")))
    met = joined.select(*keys, F.struct(F.lit(0).alias("missing"), F.col("__d").alias("distance"), F.col(code).alias("code")).alias("b"))
    # one default per replicate, a handful whatever the tables' sizes; without references there is no code to give
    defaults = [r for r in reference.groupBy(*keys[1:]).agg(F.min(code).alias("code")).collect() if r["code"] is not None]
    if defaults:
        kind = lambda c: reference.schema[c].dataType
        each = [F.struct(*[F.lit(r[c]).cast(kind(c)).alias(c) for c in keys[1:]], F.lit(r["code"]).cast(kind(code)).alias("code")) for r in defaults]
        lone = cells.select(id, F.explode(F.array(*each)).alias("d"))
        met = met.unionByName(lone.select(id, *[F.col(f"d.{c}").alias(c) for c in keys[1:]], F.struct(F.lit(1).alias("missing"), F.lit(1.0).alias("distance"), F.col("d.code").alias("code")).alias("b")))
    return met.groupBy(*keys).agg(F.min("b").alias("b")).select(*keys, "b.code", "b.distance")


def seed_hits(probes: DataFrame, targets: DataFrame, k: int, max_targets_per_seed: int | None = None) -> DataFrame:
    """Ungapped hits of probes on targets that share a k-mer, on both strands.

    probes: probe_id, seq; targets: molecule_id, seq. Seeds meet by equal k-mers; seeds of one
    diagonal are one hit, whose whole window inside the target is compared: length, matches, mch
    and the longest true run. Every seed is used; a bound on targets per seed is the caller's choice.
    """
    strands = probes.select("probe_id", F.lit("+").alias("strand"), "seq").union(probes.select("probe_id", F.lit("-"), S.reverse_complement("seq")))
    strands = strands.where("probe_id IS NOT NULL")
    own = seeds.places(strands, k).select("probe_id", "strand", F.col("at").alias("i"), "seed")
    longest = probes.agg(F.max(F.length("seq"))).first()[0] or 0
    near = longest <= NEAR
    found = seeds.places(targets.where("molecule_id IS NOT NULL").select("molecule_id", "seq"), k, *seeds.marked(own), reach=max(longest - k, 0) if near else 0)
    wanted = found.withColumnRenamed("at", "j").join(own.select("seed").distinct(), "seed", "left_semi")
    if max_targets_per_seed:
        common = wanted.groupBy("seed").agg(F.count_distinct("molecule_id").alias("n")).where(F.col("n") > max_targets_per_seed)
        wanted = wanted.join(common, "seed", "left_anti")
    diagonal = (F.col("j") - F.col("i")).alias("diagonal")
    texts = strands.withColumnRenamed("seq", "q")
    start, end = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.length("q"), F.col("n") - F.col("diagonal"))
    piece = lambda text, first: F.substring(F.col(text), (F.col("diagonal") + start - first + 1).cast("int"), end - start)
    if near:  # what a probe can reach comes with the seed: no sequence is fetched again
        rows = own.join(texts, ["probe_id", "strand"]).join(wanted, "seed").where(F.substring(F.col("q"), F.col("i") + 1, F.lit(k)) == F.substring(F.col("around"), F.col("j") - F.col("first") + 1, F.lit(k)))
        rows = rows.select("probe_id", "strand", "molecule_id", diagonal, "q", "n", "first", "around")
        rows = rows.select("probe_id", "strand", "molecule_id", "diagonal", "q", "n", piece("around", F.col("first")).alias("sseq")).distinct()
    else:
        diagonals = own.join(wanted, "seed").select("probe_id", "strand", "molecule_id", "n", diagonal).distinct()
        rows = diagonals.join(texts, ["probe_id", "strand"]).join(targets.select("molecule_id", F.col("seq").alias("t")), "molecule_id").withColumn("sseq", piece("t", F.lit(0)))
    rows = rows.withColumn("qseq", F.substring(F.col("q"), start + 1, end - start))
    rows = rows.select("probe_id", "strand", "molecule_id", (F.col("diagonal") + start + 1).alias("molecule_start"), F.length("qseq").alias("length"), seeds.aligned_runs("qseq", "sseq").alias("runs"))
    return rows.select("probe_id", "strand", "molecule_id", "molecule_start", "length", "runs.mch", "runs.run")


def lineage(ids: DataFrame, taxonomy: DataFrame, ranks: tuple[str, ...] = RANKS, depth: int | None = None) -> DataFrame:
    """The ancestor of each id at each rank, null where there is none; ids that the tree lacks are left out.

    taxonomy: taxid, parent, rank; the root is its own parent or has none. Every node knows the
    ranks on its way up to some ancestor; each round it takes over what that ancestor knows and jumps
    to where the ancestor points, so ways double: a tree of 1,000 levels takes ten joins. A ring
    never ends, and is an error once ways are longer than the tree has nodes, as is a path of more
    than `depth` nodes.
    """
    own = [F.when(F.col("rank") == r, F.col("taxid")).alias(r) for r in ranks]
    up = F.when(F.col("parent") != F.col("taxid"), F.col("parent")).alias("jump")
    asked = ids.select("taxid").distinct()
    nodes = stored(taxonomy.select("taxid", up, F.lit(1).cast("long").alias("nodes"), *own), "tree")
    size, reach = nodes.count(), 1
    while not nodes.where("jump IS NOT NULL").isEmpty():
        if reach > size:
            if not nodes.where("jump IS NOT NULL").join(asked, "taxid", "left_semi").isEmpty():
                raise ValueError("the tree has a ring")
            break
        # many nodes point to the root; Spark splits them, as the left side of a left join
        ahead = nodes.select(F.col("taxid").alias("jump"), F.col("jump").alias("next"), F.col("nodes").alias("more"), *[F.col(r).alias(f"up_{k}") for k, r in enumerate(ranks)])
        joined = nodes.join(ahead, "jump", "left")
        nodes = stored(joined.select("taxid", F.col("next").alias("jump"), (F.col("nodes") + F.coalesce("more", F.lit(0))).alias("nodes"), *[F.greatest(r, f"up_{k}").alias(r) for k, r in enumerate(ranks)]), "tree")
        reach *= 2
    found = asked.join(nodes, "taxid")
    if depth is not None and not found.where(F.col("nodes") > depth).isEmpty():
        raise ValueError(f"a path of the tree has more than {depth} nodes")
    return found.select(F.col("taxid").alias("id"), *ranks)


def lca_rank(a: str, b: str, ranks: tuple[str, ...] = RANKS) -> Column:
    """The lowest rank at which two lineages agree (columns prefixed a and b); 0 and null agree with nothing."""
    same = [F.when((F.col(f"{a}{r}") == F.col(f"{b}{r}")) & (F.col(f"{a}{r}") != 0), r) for r in reversed(ranks)]
    return F.coalesce(*same, F.lit("no rank"))


def full_matrix(long: DataFrame, keys: DataFrame, image: str, a: str, b: str, n: str) -> DataFrame:
    """All pairs of an image's classes with their count, 0 where long has none. keys: image, code (one row per class)."""
    left, right = keys.select(image, F.col("code").alias(a)), keys.select(image, F.col("code").alias(b))
    return left.join(right, image).join(long, [image, a, b], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def taxon_lookup(probes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Distinct taxon and code of the probes, with names."""
    return probes.distinct().join(names, key, "left")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
