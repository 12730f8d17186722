"""Queries of the joins (inventory 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import cells as C
from luminode.operators import hits as H
from luminode.operators import joins as J
from luminode.operators import selection
from luminode.operators.spectral_index import SpectrumIndex
from luminode.plans.base import CELLS, PIXELS, SPECTRA, cells, dna, dna_sql, documents, pixels, query, rnd, spectra, table
from luminode.plans.q_functions import GATE, GATE_SQL, THRESHOLDS


@query("SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def c01_join_lineage(spark, d):
    lineage = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return J.join_lineage(table(spark, d, "orders").select("o_orderkey", "o_custkey"), lineage, "o_custkey").select("o_orderkey", "o_custkey", "c_nationkey", "c_mktsegment")


@query(
    """WITH k AS (SELECT c_custkey, c_nationkey AS t, c_custkey % 3 AS cl FROM customer WHERE c_nationkey > 2 OR c_custkey % 3 = 0),
g AS (SELECT t, cl, count(*) AS n FROM k GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY t) AS s, count(*) OVER (PARTITION BY t) AS c FROM g)
SELECT c_custkey, CASE WHEN s = 1 OR c = 1 THEN t::VARCHAR ELSE t || '_Cluster' || cl END AS target, n AS n_sequences FROM k JOIN w USING (t, cl)"""
)
def c02_join_cluster(spark, d):
    k = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("t"), (F.col("c_custkey") % 3).alias("cl")).where("t > 2 OR cl = 0")
    return J.join_cluster(k, J.cluster_names(k, "t", "cl"), ["t", "cl"]).select("c_custkey", "target", "n_sequences")


@query("SELECT p_partkey, p_size, n, round(q, 6) + 0.0 AS q FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def c03_attach_summary(spark, d):
    s = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), rnd(F.avg("l_quantity")).alias("q"))
    return J.attach(table(spark, d, "part").select("p_partkey", "p_size"), s, "p_partkey")


@query("SELECT k AS p_partkey, p_name, v FROM (SELECT * FROM part WHERE p_size > 10) RIGHT JOIN (SELECT p_partkey AS k, unnest(range(p_partkey % 3)) AS v FROM part) ON p_partkey = k")
def c04_attach_flanks(spark, d):
    p = table(spark, d, "part")
    variants = p.where("p_partkey % 3 > 0").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 3 - 1)).alias("v"))
    return J.attach(p.where("p_size > 10").select("p_partkey", "p_name"), variants, "p_partkey", "right")


@query("SELECT user_id, coalesce(a, 0) AS n_1, coalesce(b, 0) AS n_2 FROM (SELECT user_id, count(*) AS a FROM events WHERE event_type = 'click' AND value > 50 GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS b FROM events WHERE event_type = 'error' AND value > 50 GROUP BY 1) USING (user_id)")
def c05_outer_counts(spark, d):
    of = lambda kind: table(spark, d, "events").where((F.col("event_type") == kind) & (F.col("value") > 50)).groupBy("user_id").agg(F.count("*").alias("n"))
    return J.outer_counts(of("click"), of("error"), "user_id")


_PROBLEM = "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_discount > 0.08"


@query(
    f"""WITH p AS ({_PROBLEM}), r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT l_suppkey, l_partkey, NOT EXISTS (SELECT 1 FROM p WHERE p.l_suppkey = r.l_suppkey AND p.l_partkey = r.l_partkey) AS exact_kept FROM r
WHERE NOT (l_suppkey IN (SELECT l_suppkey FROM p) AND l_partkey IN (SELECT l_partkey FROM p)) OR NOT EXISTS (SELECT 1 FROM p WHERE p.l_suppkey = r.l_suppkey AND p.l_partkey = r.l_partkey)"""
)
def c06_drop_problem(spark, d):
    li = table(spark, d, "lineitem")
    rows, bad = li.select("l_suppkey", "l_partkey").distinct(), li.where("l_quantity >= 48 AND l_discount > 0.08").select("l_suppkey", "l_partkey").distinct()
    exact, compat = J.drop_problem(rows, bad, "l_suppkey", "l_partkey"), J.drop_problem(rows, bad, "l_suppkey", "l_partkey", "compat")
    return exact.withColumn("exact_kept", F.lit(True)).union(compat.select("l_suppkey", "l_partkey").join(exact, ["l_suppkey", "l_partkey"], "left_anti").withColumn("exact_kept", F.lit(False)))


_EDGES = f"""(WITH p AS {PIXELS}, t AS (SELECT DISTINCT a.image_id, least(a.label, b.label) AS l1, greatest(a.label, b.label) AS l2
  FROM (SELECT p.*, x + dx AS nx, y + dy AS ny FROM p, (VALUES (1, 0), (0, 1), (1, 1), (1, -1)) n(dx, dy)) a JOIN p b
  ON a.image_id = b.image_id AND a.nx = b.x AND a.ny = b.y WHERE a.label <> b.label)
  SELECT image_id, l1 AS label_1, l2 AS label_2 FROM t UNION ALL SELECT image_id, l2, l1 FROM t)"""


@query(f"SELECT * FROM {_EDGES} WHERE label_1 % 3 <> 0 AND label_2 % 3 <> 0")
def c07_keep_edges(spark, d):
    px = pixels(spark, d)
    return J.keep_edges(J.adjacency(px), px.where("label % 3 <> 0").select("image_id", "label").distinct()).select("image_id", "label_1", "label_2")


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey AS taxon, l_orderkey AS id, l_orderkey % 1500 AS st, l_orderkey % 1500 + 19 AS en FROM lineitem),
r AS (SELECT l_suppkey AS taxon, l_orderkey AS id, row_number() OVER (PARTITION BY l_suppkey, (l_orderkey % 1500) // 100 ORDER BY l_discount DESC, l_extendedprice, l_orderkey, l_partkey) AS k FROM lineitem),
b AS (SELECT s.* FROM s JOIN (SELECT DISTINCT taxon, id FROM r WHERE k = 1) USING (taxon, id))
SELECT b.taxon, b.id AS source_id, c.id AS helper_id, CASE WHEN c.en < b.st - 3 THEN '5' ELSE '3' END AS side, trunc((c.st - b.st) / 20)::INT AS helper_group
FROM b JOIN s c ON b.taxon = c.taxon WHERE (c.st > b.st - 103 AND c.en < b.st - 3) OR (c.st > b.en + 3 AND c.en < b.en + 103)"""
)
def c08_helpers(spark, d):
    start = F.col("l_orderkey") % 1500
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("taxon"), F.col("l_orderkey").alias("helper_id"), start.alias("start"), (start + 19).alias("end")).distinct()
    # the sources are the best probes of each taxon's position bins
    rows = table(spark, d, "lineitem").withColumns({"taxon": F.col("l_suppkey"), "p_start": start})
    chosen = selection.best_per_bin(rows, "taxon", "p_start", 100, [F.desc("l_discount"), F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey")])
    best = chosen.select("taxon", F.col("l_orderkey").alias("source_id"), F.col("p_start").alias("start"), (F.col("p_start") + 19).alias("end")).distinct()
    return J.helpers(best, s).select("taxon", "source_id", "helper_id", "side", "helper_group")


def _interference_sql(key: str, hits: str, probes: str) -> str:
    return f"""
WITH h AS (SELECT DISTINCT * FROM ({hits})), p AS (SELECT DISTINCT * FROM ({probes})),
o AS (SELECT h.k, b, ps, ln, least(hs, ps + ln) - greatest(he, ps) AS ov FROM h JOIN p ON h.k = p.k),
e AS (SELECT k, b, ps, ln, avg((ov > 0)::INT) AS o0, avg((ov > 5)::INT) AS o5, avg((ov > 10)::INT) AS o10 FROM o GROUP BY ALL),
m AS (SELECT k, b, avg(o0) AS o0, avg(o5) AS o5, avg(o10) AS o10 FROM e GROUP BY ALL)
SELECT b AS blocker_id, round(max(o0), 6) AS over_0, round(max(o5), 6) AS over_5, round(max(o10), 6) AS over_10 FROM m GROUP BY b"""


def _rounded(df):
    return df.select("blocker_id", *[rnd(c).alias(c) for c in df.columns if c.startswith("over")])


@query(_interference_sql("taxon", "SELECT l_suppkey AS k, l_partkey % 200 AS b, l_orderkey % 300 + 20 AS hs, l_orderkey % 300 AS he FROM lineitem", "SELECT s_suppkey AS k, s_suppkey * 7 % 300 AS ps, 20 AS ln FROM supplier"))
def c09_interference(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("taxon"), (F.col("l_partkey") % 200).alias("blocker_id"), (F.col("l_orderkey") % 300 + 20).alias("hit_start"), (F.col("l_orderkey") % 300).alias("hit_end"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("taxon"), (F.col("s_suppkey") * 7 % 300).alias("p_start"), F.lit(20).alias("ln"))
    return _rounded(J.interference(h, p))


@query(
    _interference_sql(
        "molecule_id",
        "SELECT o_custkey AS k, o_orderkey % 100 AS b, o_orderkey % 150 + 20 AS hs, o_orderkey % 150 AS he FROM orders",
        "SELECT o_custkey AS k, o_orderkey % 150 AS ps, 20 AS ln FROM orders WHERE o_orderkey % 101 >= 99.9 AND o_orderkey % 3 = o_custkey % 3 UNION ALL SELECT o_custkey, o_orderkey % 150, 20 FROM orders WHERE o_orderkey % 101 >= 99.9 AND o_orderkey % 3 = o_custkey % 3",
    )
)
def c10_interference_by_molecule(spark, d):
    o = table(spark, d, "orders").withColumn("molecule_id", F.col("o_custkey"))
    h = o.select("molecule_id", (F.col("o_orderkey") % 100).alias("blocker_id"), (F.col("o_orderkey") % 150 + 20).alias("hit_start"), (F.col("o_orderkey") % 150).alias("hit_end"))
    p = o.select("molecule_id", (F.col("o_orderkey") % 150).alias("p_start"), F.lit(20).alias("ln"), (F.col("o_orderkey") % 101).alias("qcovhsp"), (F.col("o_orderkey") % 3).alias("mch"), (F.col("o_custkey") % 3).alias("length"))
    return _rounded(J.interference_by_molecule(h, p))


@query(
    """WITH e AS (SELECT event_id, user_id, ts, event_type = 'signup' AS f FROM events),
m AS (SELECT a.event_id, b.event_id AS nearest_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.event_id) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.f)
SELECT e.event_id, nearest_id FROM e LEFT JOIN m ON m.event_id = e.event_id AND r = 1"""
)
def c11_nearest_in_time(spark, d):
    e = table(spark, d, "events").withColumn("flag", (F.col("event_type") == "signup").cast("int"))
    return J.nearest_flagged(e, "user_id", "ts", "flag", "event_id").select("event_id", "nearest_id")


@query(f"SELECT image_id, code, a.cell AS id_1, b.cell AS id_2, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM {CELLS} a JOIN {CELLS} b USING (image_id, code) WHERE a.cell < b.cell AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60")
def c12_pairs_within(spark, d):
    return J.pairs_within(cells(spark, d), 60).select("image_id", "code", "id_1", "id_2", rnd("distance").alias("distance"))


POINTS = "(SELECT c_custkey % 4 AS image_id, c_custkey AS point_id, (c_acctbal % 400) - 200 AS px, (c_custkey * 37 % 400)::DOUBLE - 200 AS py FROM customer)"


def points(spark, d):
    c = table(spark, d, "customer")
    return c.select((F.col("c_custkey") % 4).alias("image_id"), F.col("c_custkey").alias("point_id"), (F.col("c_acctbal") % 400 - 200).alias("px"), ((F.col("c_custkey") * 37 % 400).cast("double") - 200).alias("py"))


@query(f"SELECT point_id, cell, r AS rank FROM (SELECT point_id, cell, row_number() OVER (PARTITION BY image_id, point_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), cell) AS r FROM {POINTS} JOIN {CELLS} USING (image_id)) WHERE r <= 5")
def c13_knn_points(spark, d):
    return J.knn_points(points(spark, d), cells(spark, d), 5).select("point_id", "cell", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT cell, round(min(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 6) AS distance FROM {CELLS} JOIN {POINTS} USING (image_id) GROUP BY cell")
def c14_min_distance(spark, d):
    b = points(spark, d).select("image_id", F.col("px").alias("bx"), F.col("py").alias("by"))
    return J.min_distance(cells(spark, d), b).select("cell", rnd("distance").alias("distance"))


@query(f"SELECT * FROM {_EDGES}")
def c15_adjacency(spark, d):
    return J.adjacency(pixels(spark, d)).select("image_id", "label_1", "label_2")


_MEANS = f"(SELECT label, replicate, list(m ORDER BY k) AS v FROM (SELECT label, vec_id % 2 AS replicate, k, round(avg(x), 9) AS m FROM (SELECT label, vec_id, unnest(range(64)) AS k, unnest(v) AS x FROM {SPECTRA}) GROUP BY ALL) GROUP BY ALL)"
_REF = f"(SELECT label AS code, {GATE_SQL} AS f, v AS w, replicate FROM {_MEANS})"


def references(spark, d):
    """label, replicate, v: mean spectra over all spectra of a class, two replicates each."""
    means = C.mean_array(spectra(spark, d).withColumn("replicate", F.col("vec_id") % 2), ["label", "replicate"], "v")
    return means.withColumn("v", F.transform("v", lambda x: F.round(x, 9)))


_COS = "(1 - list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))))"
_BLOCKED = f"(SELECT vec_id, v, {GATE_SQL} AS f FROM {SPECTRA})"


@query(
    f"""WITH r AS MATERIALIZED {_REF}, n AS (SELECT vec_id, replicate, code, {_COS} AS dist, row_number() OVER (PARTITION BY vec_id, replicate ORDER BY round({_COS}, 9), code) AS k FROM {_BLOCKED} JOIN r USING (f)),
d AS (SELECT replicate, min(code) AS least FROM r GROUP BY replicate)
SELECT s.vec_id, d.replicate, coalesce(code, least) AS code, round(round(coalesce(dist, 1.0), 9), 6) + 0.0 AS distance FROM {SPECTRA} s CROSS JOIN d LEFT JOIN n ON n.vec_id = s.vec_id AND n.replicate = d.replicate AND k = 1"""
)
def c16_nearest_spectrum(spark, d):
    s = spectra(spark, d).withColumn("flags", S.gate("v", GATE, THRESHOLDS))
    ref = references(spark, d).select(F.col("label").alias("code"), S.gate("v", GATE, THRESHOLDS).alias("flags"), F.col("v").alias("ref_v"), "replicate")
    out = J.nn_classify(s.select("vec_id", "flags", "v"), ref, lambda a, b: F.round(S.cosine(a, b), 9), "vec_id")
    return out.select("vec_id", "replicate", "code", rnd("distance").alias("distance"))


_MANY = f"""(SELECT label AS code, {GATE_SQL} AS f, v AS w FROM (SELECT label, list(m ORDER BY k) AS v FROM (SELECT label, vec_id // 100 AS run, k, round(avg(x), 9) AS m
  FROM (SELECT label, vec_id, unnest(range(64)) AS k, unnest(v) AS x FROM {SPECTRA}) GROUP BY ALL) GROUP BY label, run))"""


@query(
    f"""WITH r AS MATERIALIZED {_MANY}, n AS (SELECT vec_id, code, {_COS} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY round({_COS}, 9), code) AS k FROM {_BLOCKED} JOIN r USING (f))
SELECT s.vec_id, coalesce(code, (SELECT min(code) FROM r)) AS code, round(round(coalesce(dist, 1.0), 9), 6) + 0.0 AS distance FROM {SPECTRA} s LEFT JOIN n ON n.vec_id = s.vec_id AND k = 1"""
)
def c16_indexed_spectrum(spark, d):
    """All spectra against references that grow with the table: a class's mean over each hundred spectra."""
    runs = C.mean_array(spectra(spark, d).withColumn("run", F.floor(F.col("vec_id") / 100)), ["label", "run"], "v").withColumn("v", F.transform("v", lambda x: F.round(x, 9)))
    ref = runs.select(F.col("label").alias("code"), S.gate("v", GATE, THRESHOLDS).alias("flags"), F.col("v").alias("ref_v"))
    s = spectra(spark, d).select("vec_id", S.gate("v", GATE, THRESHOLDS).alias("flags"), "v")
    return SpectrumIndex(ref).nearest(s, "vec_id").select("vec_id", "code", rnd("distance").alias("distance"))


_SEED = 16


@query(
    f"""WITH p0 AS (SELECT item_id AS probe_id, {dna_sql('text')} AS q FROM benchmark), p AS (SELECT probe_id, '+' AS strand, q FROM p0 UNION ALL SELECT probe_id, '-', reverse(translate(q, 'ACGTN', 'TGCAN')) FROM p0),
t AS (SELECT doc_id AS molecule_id, min({dna_sql('text')}) AS t FROM documents GROUP BY 1),
ps AS (SELECT probe_id, strand, i, substr(q, i, {_SEED}) AS seed FROM (SELECT *, unnest(range(1, length(q) - {_SEED} + 2)) AS i FROM p)),
ts AS (SELECT molecule_id, j, substr(t, j, {_SEED}) AS seed FROM (SELECT *, unnest(range(1, length(t) - {_SEED} + 2)) AS j FROM t)),
g AS (SELECT DISTINCT probe_id, strand, molecule_id, j - i AS diag FROM ps JOIN ts USING (seed)),
w AS (SELECT g.*, substr(q, greatest(0, -diag) + 1, least(length(q), length(t) - diag) - greatest(0, -diag)) AS a, substr(t, diag + greatest(0, -diag) + 1, least(length(q), length(t) - diag) - greatest(0, -diag)) AS b, diag + greatest(0, -diag) + 1 AS st FROM g JOIN p USING (probe_id, strand) JOIN t USING (molecule_id)),
m AS (SELECT *, list_filter(range(length(a)), lambda i: a[i + 1] <> b[i + 1]) AS mm, length(a) AS n FROM w)
SELECT probe_id, strand, molecule_id, st AS molecule_start, n AS length,
  CASE WHEN len(mm) = 0 THEN n ELSE list_max(list_concat(list_transform(range(1, len(mm)), lambda k: mm[k + 1] - mm[k]), [mm[1], n - 1 - mm[-1]])) END AS mch FROM m"""
)
def c17_seed_hits(spark, d):
    p = table(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), dna("text").alias("seq"))
    t = documents(spark, d).groupBy(F.col("doc_id").alias("molecule_id")).agg(F.min(dna("text")).alias("seq"))
    h = J.seed_hits(p, t, _SEED)
    return h.select("probe_id", "strand", "molecule_id", *[F.col(c).cast("long").alias(c) for c in ("molecule_start", "length", "mch")])


@query()
def c17_gapped_hits(spark, d):
    """Local alignments of all items with all documents, gaps allowed, at least 30 matches more than they cost."""
    p = table(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), dna("text").alias("seq"))
    t = documents(spark, d).groupBy(F.col("doc_id").alias("molecule_id")).agg(F.min(dna("text")).alias("seq"))
    h = H.gapped_hits(p, t, k=_SEED, window=4, least=30)
    columns = "probe_id, strand, molecule_id, score, length, matches, mismatch, gapopen, probe_start, probe_end, molecule_start, molecule_end, mch"
    return h.select(*columns.split(", "), rnd("pid").alias("pid"), rnd("qcovhsp").alias("qcovhsp"), rnd("bitscore").alias("bitscore"))


TREE = """(SELECT 'r' || r_regionkey AS taxid, 'root' AS parent, 'phylum' AS rank FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'family' FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'species' FROM customer UNION ALL SELECT 'root', NULL, 'superkingdom')"""


def tree(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = [
        table(spark, d, "region").select(name("r", "r_regionkey").alias("taxid"), F.lit("root").alias("parent"), F.lit("phylum").alias("rank")),
        table(spark, d, "nation").select(name("n", "n_nationkey").alias("taxid"), name("r", "n_regionkey").alias("parent"), F.lit("family").alias("rank")),
        table(spark, d, "customer").select(name("c", "c_custkey").alias("taxid"), name("n", "c_nationkey").alias("parent"), F.lit("species").alias("rank")),
        spark.createDataFrame([("root", None, "superkingdom")], "taxid string, parent string, rank string"),
    ]
    return J.union_all(*rows)


@query("SELECT 'c' || c_custkey AS id, 'root' AS superkingdom, 'r' || n_regionkey AS phylum, 'n' || c_nationkey AS family, 'c' || c_custkey AS species, NULL::VARCHAR AS genus FROM customer JOIN nation ON n_nationkey = c_nationkey")
def c18_lineage(spark, d):
    t = tree(spark, d)
    return J.lineage(t.where("rank = 'species'"), t).select("id", "superkingdom", "phylum", "family", "species", "genus")


@query(
    """WITH l AS (SELECT c_custkey, n_regionkey AS phylum, c_nationkey AS family, c_custkey AS species FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT a.c_custkey, CASE WHEN a.family = b.family AND a.family <> 0 THEN 'family' WHEN a.phylum = b.phylum AND a.phylum <> 0 THEN 'phylum' ELSE 'no rank' END AS rank FROM l a JOIN l b ON b.c_custkey = a.c_custkey + 1"""
)
def c19_common_rank(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = lambda p, k: c.select((F.col("c_custkey") - k).alias("c_custkey"), F.col("n_regionkey").alias(f"{p}phylum"), F.col("c_nationkey").alias(f"{p}family"), F.col("c_custkey").alias(f"{p}species"))
    return of("a_", 0).join(of("b_", 1), "c_custkey").select("c_custkey", J.lca_rank("a_", "b_", ("phylum", "family", "species")).alias("rank"))


@query(
    f"""WITH k AS (SELECT DISTINCT image_id, code FROM {CELLS}), n AS (SELECT a.image_id, a.code AS c1, b.code AS c2, count(*) AS n FROM {CELLS} a JOIN {CELLS} b ON a.image_id = b.image_id AND b.cell = a.cell + 4 GROUP BY ALL)
SELECT a.image_id, a.code AS code_1, b.code AS code_2, coalesce(n, 0) AS n FROM k a JOIN k b ON a.image_id = b.image_id LEFT JOIN n ON n.image_id = a.image_id AND c1 = a.code AND c2 = b.code"""
)
def c20_full_matrix(spark, d):
    c = cells(spark, d).select("image_id", "cell", "code")
    after = c.select("image_id", (F.col("cell") - 4).alias("cell"), F.col("code").alias("code_2"))
    long = c.withColumnRenamed("code", "code_1").join(after, ["image_id", "cell"]).groupBy("image_id", "code_1", "code_2").agg(F.count("*").alias("n"))
    return J.full_matrix(long, c.select("image_id", "code").distinct(), "image_id", "code_1", "code_2", "n").select("image_id", "code_1", "code_2", "n")


@query("SELECT DISTINCT c_nationkey, lpad(bin(c_nationkey::BIGINT), 7, '0') AS code, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def c21_taxon_lookup(spark, d):
    p = table(spark, d, "customer").select("c_nationkey", S.to_bits("c_nationkey", 7).alias("code"))
    return J.taxon_lookup(p, table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
