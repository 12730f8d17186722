"""Queries of the aggregations and selections (inventory 2.4, 2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import cells as C
from luminode.operators import joins as J
from luminode.operators import probes, selection, summaries
from luminode.plans.base import CELLS, HITS, PIXELS, SPECTRA, cells, dna, dna_sql, documents, hits, pixels, query, rnd, rnd_scaled, spectra, table
from luminode.plans.q_joins import _EDGES, POINTS, points
from luminode.sources.shared import stored

@query("SELECT *, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS fraction FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def d01_abundance(spark, d):
    a = summaries.abundance(table(spark, d, "events"), ["user_id"], "event_type")
    return a.select("user_id", "event_type", "n", rnd("fraction").alias("fraction"))


def _summary_input(spark, d):
    h = hits(spark, d)
    return h.withColumns({"tm": F.col("bitscore") / 2, "gc": F.col("length"), "full_match": F.col("full_hit") & (F.col("mch") == F.col("length"))})


_SUMMARY = f"""
WITH h AS (SELECT *, bitscore / 2 AS tm, length AS gc, full_hit AND mch = length AS full_match, mch >= 18 OR length >= 18 AS hit, mch < 18 AS below FROM {HITS}),
a AS (SELECT probe_id, count(*) AS abundance FROM h WHERE full_hit GROUP BY 1)
SELECT h.probe_id, round(coalesce(avg(target_hit::INT) FILTER (hit), 0), 6) AS on_target_rate, round(coalesce(avg(full_hit::INT) FILTER (hit), 0), 6) AS on_target_full_rate,
  round(coalesce(min(evalue) FILTER (below), 100), 6) AS off_target_min_evalue, round(coalesce(max(bitscore) FILTER (below), 0), 6) AS off_target_max_bitscore,
  coalesce(max(mch) FILTER (below), 0) AS off_target_max_mch, round(coalesce(arg_max(qcovhsp, mch * 1000.0 + qcovhsp) FILTER (below), 0), 6) AS off_target_max_mch_qcovhsp,
  round(coalesce(avg((qcovhsp > 99.9)::INT) FILTER (below), 0), 6) AS off_target_full_qcovhsp_fraction, round(coalesce(max(tm) FILTER (below), 0), 6) AS off_target_max_tm,
  coalesce(max(gc) FILTER (below), 0) AS off_target_max_gc, any_value(abundance) AS abundance,
  round(coalesce(count(*) FILTER (hit AND full_hit), 0) / any_value(abundance), 6) AS taxon_coverage,
  round(CASE WHEN count(*) FILTER (hit) > 0 THEN count(*) FILTER (full_match) ELSE 0 END / any_value(abundance), 6) AS on_target_full_match
FROM h LEFT JOIN a ON a.probe_id = h.probe_id GROUP BY h.probe_id"""


def summary(spark, d):
    h = _summary_input(spark, d)
    return summaries.probe_summary(h, summaries.target_abundance(h.where("full_hit"), "probe_id"), 18)


@query(_SUMMARY)
def d02_d03_probe_summary(spark, d):
    s = summary(spark, d)
    return s.select(*[rnd(c).alias(c) if t == "double" else c for c, t in s.dtypes])


@query("SELECT o_custkey, count(*) AS abundance FROM orders GROUP BY 1")
def d04_target_abundance(spark, d):
    return summaries.target_abundance(table(spark, d, "orders"), "o_custkey")


@query(
    """WITH l AS (SELECT o_custkey % 50 AS probe, c_nationkey AS f, n_regionkey AS p, o_orderstatus = 'F' AS hit, (o_orderkey % 25) AS tf FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT l.*, CASE WHEN f = tf AND f <> 0 THEN 'family' WHEN p = n_regionkey AND p <> 0 THEN 'phylum' ELSE 'no rank' END AS rank FROM l JOIN nation ON n_nationkey = tf)
SELECT probe, round(coalesce(avg((rank = 'family')::INT) FILTER (NOT hit), 0), 6) AS family, round(coalesce(avg((rank = 'phylum')::INT) FILTER (NOT hit), 0), 6) AS phylum, round(coalesce(avg((rank = 'no rank')::INT) FILTER (NOT hit), 0), 6) AS no_rank FROM r GROUP BY probe"""
)
def d05_offtarget_ranks(spark, d):
    n = table(spark, d, "nation")
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a_family")), "o_custkey")
    o = o.withColumn("b_family", (F.col("o_orderkey") % 25).cast("int"))
    for k in "ab":
        o = J.join_lineage(o, n.select(F.col("n_nationkey").alias(f"{k}_family"), F.col("n_regionkey").alias(f"{k}_phylum")), f"{k}_family")
    ranked = o.select((F.col("o_custkey") % 50).alias("probe"), (F.col("o_orderstatus") == "F").alias("hit"), J.lca_rank("a_", "b_", ("phylum", "family")).alias("rank"))
    out = summaries.offtarget_ranks(ranked, "probe", "rank", "hit", ("family", "phylum", "no rank"))
    return out.select("probe", *[rnd(c).alias(c) for c in ("family", "phylum", "no_rank")])


_CANDS = "(SELECT o_orderkey % 4000 AS seq, n_regionkey AS phylum, c_nationkey AS family, c_custkey AS species FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def candidates(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select((F.col("o_orderkey") % 4000).alias("seq"), F.col("n_regionkey").alias("phylum"), F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("species"))


_CONSOLIDATED = f"""(SELECT seq, n, l AS level, CASE WHEN l > 0 THEN p END AS phylum, CASE WHEN l > 1 THEN f END AS family, CASE WHEN l > 2 THEN s END AS species FROM (
  SELECT seq, count(*) AS n, 3 - (count(DISTINCT phylum) > 1)::INT - (count(DISTINCT family) > 1)::INT - (count(DISTINCT species) > 1)::INT AS l, min(phylum) AS p, min(family) AS f, min(species) AS s FROM {_CANDS} GROUP BY seq))"""


@query(f"SELECT * FROM {_CONSOLIDATED}")
def d06_d07_consolidate(spark, d):
    return summaries.consolidate(candidates(spark, d), "seq", ("phylum", "family", "species"))


@query(f"SELECT at_level, count(*) AS n FROM (SELECT unnest(range(level + 1))::INT AS at_level FROM {_CONSOLIDATED}) GROUP BY 1")
def d08_by_level(spark, d):
    return summaries.by_level(summaries.consolidate(candidates(spark, d), "seq", ("phylum", "family", "species"))).groupBy("at_level").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def d09_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag").dropDuplicates()


@query(f"SELECT taxon, round(coalesce(count(DISTINCT CASE WHEN chosen THEN molecule_id END), 0) / count(DISTINCT molecule_id), 6) AS coverage FROM (SELECT *, bool_or(mch >= 48) OVER (PARTITION BY taxon, probe_id) AS chosen FROM {HITS}) GROUP BY taxon")
def d10_union_coverage(spark, d):
    h = hits(spark, d)
    whole = h.groupBy("taxon").agg(F.count_distinct("molecule_id").alias("abundance"))
    return summaries.union_coverage(h, h.where("mch >= 48").select("taxon", "probe_id").distinct(), whole).select("taxon", rnd("coverage").alias("coverage"))


@query(f"SELECT DISTINCT molecule_id, probe_id FROM {HITS} WHERE mch >= 40 AND qcovhsp >= 80")
def d11_cover(spark, d):
    return summaries.cover(hits(spark, d), 40, 80)


@query(f"SELECT count(*) AS molecules, round(avg(b), 6) AS mean_coverage, round(avg((b > 0)::INT), 6) AS detectable FROM (SELECT molecule_id, max(qcovhsp) AS b FROM {HITS} GROUP BY 1)")
def d12_detectability(spark, d):
    out = summaries.detectability(hits(spark, d).withColumnRenamed("qcovhsp", "coverage"))
    return out.select("molecules", rnd("mean_coverage").alias("mean_coverage"), rnd("detectable").alias("detectable"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p, n + 1e-7 AS v, row_number() OVER (PARTITION BY user_id ORDER BY n) AS i FROM c)
SELECT user_id, count(*)::INT AS richness, round(count(*) / (SELECT count(DISTINCT event_type) FROM events), 6) AS richness_fraction, round(-sum(p * ln(p)), 6) + 0.0 AS shannon, round(1 / sum(p * p), 6) AS inverse_simpson, round(sum(2 * i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) + 0.0 AS gini FROM p GROUP BY user_id"""
)
def d13_d14_d15_d16_diversity(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    both = summaries.diversity(c, ["user_id"]).join(summaries.richness_fraction(c, ["user_id"], "event_type"), "user_id")
    return both.select("user_id", rnd("richness_fraction").alias("richness_fraction"), F.col("richness").cast("int").alias("richness"), *[rnd(x).alias(x) for x in ("shannon", "inverse_simpson", "gini")])


@query("SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS n_encoding, round(avg((l_returnflag = 'A')::INT), 6) AS encoding_fraction, count(*) FILTER (l_tax < 0.05) AS n_kept, count(*) FILTER (l_tax < 0.05 AND l_returnflag = 'A') AS n_kept_encoding FROM lineitem")
def d17_pool_report(spark, d):
    r = summaries.pool_report(table(spark, d, "lineitem"), F.col("l_tax") < 0.05, F.col("l_returnflag") == "A")
    return r.withColumn("encoding_fraction", rnd("encoding_fraction"))


@query("SELECT l_suppkey, count(*) AS n_probes FROM lineitem WHERE l_discount > 0.07 GROUP BY 1")
def d18_probes_per_taxon(spark, d):
    return summaries.probes_per_taxon(table(spark, d, "lineitem"), "l_suppkey", "l_discount", 0.07)


@query(f"SELECT probe_id, round(coalesce(avg((target_hit OR (st >= 44 AND st < 64))::INT) FILTER (mch >= 20), 0), 6) AS checked FROM (SELECT *, l_suppkey AS st FROM {HITS}) GROUP BY probe_id")
def d19_final_check(spark, d):
    return summaries.final_check(hits(spark, d).withColumn("start", F.col("l_suppkey")), 20, 44, 20).select("probe_id", rnd("checked").alias("checked"))


@query(f"SELECT taxon, count(DISTINCT nullif(probe_id, 0)) AS plurality, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS fraction FROM {HITS} GROUP BY taxon")
def d20_plurality(spark, d):
    return summaries.plurality(hits(spark, d), "taxon", "probe_id").select("taxon", "plurality", rnd("fraction").alias("fraction"))


@query("SELECT l_suppkey, l_linenumber, max(l_quantity) AS max_gc FROM lineitem GROUP BY ALL")
def d21_offtarget_gc(spark, d):
    return summaries.offtarget_gc(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity")


_REGIONS = f"""(SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS rt FROM (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(x) + 1.0 / 12 AS xx, var_pop(y) + 1.0 / 12 AS yy, covar_pop(x, y) AS xy, avg(v) AS mi, sum(v) AS ti FROM {PIXELS} GROUP BY ALL))"""


@query(
    f"""SELECT image_id, label, area, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(4 * sqrt((xx + yy + rt) / 2), 6) AS major_axis, round(4 * sqrt((xx + yy - rt) / 2), 6) AS minor_axis, round(0.5 * atan2(2 * xy, xx - yy), 6) + 0.0 AS orientation,
  round(sqrt(greatest(0, 1 - (xx + yy - rt) / (xx + yy + rt))), 6) AS eccentricity, round(mi, 9) AS mean_intensity, round(ti, 4) AS total_intensity FROM {_REGIONS}"""
)
def d22_d23_regions(spark, d):
    m = C.measure_regions(pixels(spark, d), intensity="v")
    return m.select("image_id", "label", "area", *[rnd(c).alias(c) for c in ("centroid_x", "centroid_y", "major_axis", "minor_axis", "orientation", "eccentricity")], rnd("mean_intensity", 9).alias("mean_intensity"), rnd("total_intensity", 4).alias("total_intensity"))


_PX3 = f"(SELECT image_id, x, y, label, [v, v * (x + 1), v * (y + 2)] AS w FROM {PIXELS})"


def _px3(spark, d):
    v = F.col("v")
    return pixels(spark, d).withColumn("intensity", F.array(v, v * (F.col("x") + 1), v * (F.col("y") + 2)))


@query(
    f"""SELECT image_id, label, list(m ORDER BY k) AS spectrum FROM (SELECT image_id, label, k, sum(i)::DOUBLE / count(*) / 1000000 AS m FROM
  (SELECT image_id, label, unnest([1, 2, 3]) AS k, unnest([u, u * (x + 1), u * (y + 2)]) AS i FROM (SELECT *, round(v * 1000000)::BIGINT AS u FROM {PIXELS})) GROUP BY ALL) GROUP BY ALL"""
)
def d22_mean_spectrum(spark, d):
    # intensities (of two decimals) as whole millionths: their sums are exact in any order, and no mean needs rounding
    u = F.round(F.col("v") * 1000000).cast("long")
    px = pixels(spark, d).withColumn("intensity", F.array(u, u * (F.col("x") + 1), u * (F.col("y") + 2)))
    m = C.measure_regions(px, spectrum="intensity")
    return m.select("image_id", "label", F.transform("intensity", lambda x: x / F.lit(1000000.0)).alias("spectrum"))


def _centroid_sql(keys: str, rows: str) -> str:
    return f"""WITH p AS ({rows}), g AS (SELECT {keys}, avg(x) AS gx, avg(y) AS gy FROM p GROUP BY ALL),
c AS (SELECT {keys}, k, sum(x * i) / sum(i) AS wx, sum(y * i) / sum(i) AS wy FROM (SELECT {keys}, x, y, unnest([1, 2, 3]) AS k, unnest(w) AS i FROM p) GROUP BY ALL)
SELECT {keys}, round(quantile_cont(sqrt((wx - gx) * (wx - gx) + (wy - gy) * (wy - gy)), 0.5), 6) AS centroid_distance FROM c JOIN g USING ({keys}) GROUP BY {keys}"""


@query(_centroid_sql("image_id, label", f"SELECT * FROM {_PX3}"))
def d24_spectral_centroid(spark, d):
    return C.spectral_centroid(_px3(spark, d), ["image_id", "label"]).select("image_id", "label", rnd("centroid_distance").alias("centroid_distance"))


_PAIR_ROWS = f"SELECT e.image_id, label_1, label_2, x, y, w FROM {_EDGES} e JOIN {_PX3} p ON p.image_id = e.image_id AND p.label IN (label_1, label_2) WHERE label_1 < label_2"


@query(_centroid_sql("image_id, label_1, label_2", _PAIR_ROWS))
def d25_pair_centroid(spark, d):
    return C.pair_centroid(_px3(spark, d)).select("image_id", "label_1", "label_2", rnd("centroid_distance").alias("centroid_distance"))


@query("SELECT p_size, threshold, round(avg((p_retailprice / 700 > threshold)::INT), 6) AS separated FROM (SELECT p_size, p_retailprice, unnest([1.2, 1.3, 1.4]::DOUBLE[]) AS threshold FROM part) GROUP BY ALL")
def d26_separation_rate(spark, d):
    p = table(spark, d, "part").withColumn("dist", F.col("p_retailprice") / 700)
    return C.separation_rate(p, "dist", ["p_size"], [1.2, 1.3, 1.4]).withColumn("separated", rnd("separated"))


@query(f"SELECT label, count(*) AS n, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std FROM (SELECT label, list_max(v) AS t FROM {SPECTRA}) GROUP BY label")
def d27_snr_summary(spark, d):
    s = summaries.value_summary(spectra(spark, d).withColumn("t", F.array_max("v")), ["label"], "t")
    return s.select("label", "n", rnd("mean").alias("mean"), rnd("std").alias("std"))


@query(f"SELECT label, list(m ORDER BY k) AS v FROM (SELECT label, k, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(64)) AS k, unnest(v) AS x FROM {SPECTRA}) GROUP BY ALL) GROUP BY label")
def d28_mean_spectrum(spark, d):
    return C.mean_array(spectra(spark, d), ["label"], "v").select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(f"SELECT channel::INT AS channel, bin, round(log10(count(*) + 1), 6) AS log_n FROM (SELECT unnest(range(64)) AS channel, (floor(unnest(v) / 0.05) + 1)::BIGINT AS bin FROM {SPECTRA}) GROUP BY ALL")
def d29_spectrum_histogram(spark, d):
    return C.spectrum_histogram(spectra(spark, d), "v", 20).select("channel", F.col("bin").cast("long").alias("bin"), rnd("log_n").alias("log_n"))


@query(
    """WITH t AS (SELECT event_type, user_id, count(*) AS total FROM events GROUP BY ALL), c AS (SELECT event_type, user_id, floor(value / 10)::INT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 200 GROUP BY ALL),
s AS (SELECT event_type, user_id, total, unnest(range(20))::INT AS bin FROM t), f AS (SELECT event_type, bin, coalesce(n, 0) / total AS share FROM s LEFT JOIN c USING (event_type, user_id, bin))
SELECT event_type, bin, round(avg(share), 6) AS mean, round(quantile_cont(share, 0.25), 6) AS q25, round(quantile_cont(share, 0.75), 6) AS q75 FROM f GROUP BY ALL"""
)
def d30_distance_profile(spark, d):
    p = C.distance_profile(table(spark, d, "events"), ["event_type"], "user_id", "value", 10, 20)
    return p.select("event_type", "bin", *[rnd(c).alias(c) for c in ("mean", "q25", "q75")])


_TWO = "(SELECT user_id, event_type, user_id % 2 AS grp, count(*)::DOUBLE AS n FROM events GROUP BY ALL)"


def _two(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type", (F.col("user_id") % 2).alias("grp")).agg(F.count("*").cast("double").alias("n"))


@query(
    "SELECT event_type, "
    + ", ".join(f"round(coalesce(avg(n) FILTER (grp = {g}), 0.1), 6) AS mean_{k}, round(stddev_samp(n) FILTER (grp = {g}), 6) AS std_{k}, round(quantile_cont(n, 0.25) FILTER (grp = {g}), 6) AS q25_{k}, round(quantile_cont(n, 0.75) FILTER (grp = {g}), 6) AS q75_{k}" for k, g in ((1, 0), (2, 1)))
    + f" FROM {_TWO} GROUP BY event_type"
)
def d31_compare_groups(spark, d):
    c = C.compare_groups(_two(spark, d), "event_type", "grp", "n", (0, 1))
    return c.select("event_type", *[rnd(x).alias(x) for x in c.columns if x != "event_type"])


@query("SELECT n_regionkey AS region, c_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
def d32_rollup_rank(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return summaries.rollup_counts(j.select(F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation")), ["region", "nation"])


@query("SELECT vec_id % 20 AS sample, count(*) AS n, round(CASE WHEN avg((label > 8)::INT) = 0 THEN 1 / count(*) ELSE avg((label > 8)::INT) END, 6) AS error_rate, avg((label > 8)::INT) = 0 AS at_limit FROM embeddings GROUP BY 1")
def d33_error_rate(spark, d):
    e = table(spark, d, "embeddings").withColumn("sample", F.col("vec_id") % 20)
    return C.error_rate(e, ["sample"], F.col("label") > 8).withColumn("error_rate", rnd("error_rate"))


@query("WITH h AS (SELECT p_brand, bit_count(xor(p_partkey % 128, (p_size * 37) % 128))::INT AS hd FROM part) SELECT b.p_brand, s.hd, count(h.hd) AS n FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT unnest(range(8))::INT AS hd) s LEFT JOIN h ON h.p_brand = b.p_brand AND h.hd = s.hd GROUP BY ALL")
def d34_hamming_histogram(spark, d):
    p = table(spark, d, "part").withColumn("h", S.hamming(F.col("p_partkey") % 128, (F.col("p_size") * 37 % 128).cast("long")))
    return C.hamming_histogram(p, ["p_brand"], "h", 7)


# rows are compared by exact sums: of whole numbers the mean and the deviation are no doubles that depend on the order of rows
_GATE = """(SELECT l_suppkey, a, b, (count(a) OVER w)::HUGEINT AS na, sum(a) OVER w AS sa, sum(a * a) OVER w AS qa, (count(b) OVER w)::HUGEINT AS nb, sum(b) OVER w AS sb, sum(b * b) OVER w AS qb
  FROM (SELECT l_suppkey, round(l_quantity * 100)::HUGEINT AS a, l_linenumber::HUGEINT AS b FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey))"""


def _gated(spark, d, mode):
    rows = table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(12,2)"))
    return C.sigma_gate(rows, "l_suppkey", ["l_quantity", "l_linenumber"], mode).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(f"SELECT l_suppkey, count(*) AS n FROM {_GATE} WHERE (na * a - sa) * (na * a - sa) <= na * qa - sa * sa AND (nb * b - sb) * (nb * b - sb) <= nb * qb - sb * sb GROUP BY 1")
def d35_sigma_gate(spark, d):
    return _gated(spark, d, "within")


_ABOVE = "n{0} > 1 AND (n{0} * {0} > s{0} OR (n{0} - 1) * (n{0} * {0} - s{0}) * (n{0} * {0} - s{0}) < n{0} * (n{0} * q{0} - s{0} * s{0}))"


@query(f"SELECT l_suppkey, count(*) AS n FROM {_GATE} WHERE {_ABOVE.format('a')} AND {_ABOVE.format('b')} GROUP BY 1")
def d35_sigma_above(spark, d):
    return _gated(spark, d, "above")


_NET = f"(SELECT image_id, label_1 % 4 AS code_1, label_2 % 4 AS code_2, count(*) AS n FROM {_EDGES} GROUP BY ALL)"


def _network(spark, d):
    px = pixels(spark, d)
    own = px.select("image_id", "label").distinct().withColumn("code", F.col("label") % 4)
    return J.adjacency(px), own


@query(f"SELECT * FROM {_NET}")
def d36_adjacency_counts(spark, d):
    return C.adjacency_counts(*_network(spark, d))


@query(f"WITH s AS (SELECT image_id, label % 4 AS code, count(*) AS size FROM (SELECT DISTINCT image_id, label FROM {PIXELS}) GROUP BY ALL) SELECT n.image_id, code_1, code_2, round(n / (a.size * b.size), 6) AS association FROM {_NET} n JOIN s a ON a.image_id = n.image_id AND a.code = code_1 JOIN s b ON b.image_id = n.image_id AND b.code = code_2")
def d37_association(spark, d):
    edges, own = _network(spark, d)
    return C.association(C.adjacency_counts(edges, own), own).withColumn("association", rnd("association"))


@query(
    f"""WITH c AS (SELECT DISTINCT image_id, label, label % 4 AS code FROM {PIXELS}), s AS (SELECT *, sim FROM c CROSS JOIN (SELECT unnest(range(1, 11)) AS sim)),
p AS (SELECT image_id, sim, label, row_number() OVER (PARTITION BY image_id, sim ORDER BY label) AS r FROM s), q AS (SELECT image_id, sim, code, row_number() OVER (PARTITION BY image_id, sim ORDER BY md5(sim || '-' || label), label) AS r FROM s),
k AS (SELECT image_id, sim, label, code FROM p JOIN q USING (image_id, sim, r)),
n AS (SELECT e.image_id, a.sim, a.code AS code_1, b.code AS code_2, count(*) AS n FROM {_EDGES} e JOIN k a ON a.image_id = e.image_id AND a.label = label_1 JOIN k b ON b.image_id = e.image_id AND b.sim = a.sim AND b.label = label_2 GROUP BY ALL),
m AS (SELECT image_id, code_1, code_2, sum(n) / 10 AS mean, sqrt(greatest(0, sum(n * n) / 10 - (sum(n) / 10) * (sum(n) / 10))) AS std FROM n GROUP BY ALL)
SELECT image_id, code_1, code_2, coalesce(o.n, 0) AS n, round(coalesce(mean, 0), 6) AS null_mean, round(coalesce(std, 0), 6) AS null_std, round((coalesce(o.n, 0) + 1) / (coalesce(mean, 0) + 1), 6) AS fold_change FROM m FULL JOIN {_NET} o USING (image_id, code_1, code_2)"""
)
def d38_permutation_null(spark, d):
    edges, own = _network(spark, d)
    key = F.md5(F.concat_ws("-", F.col("sim").cast("string"), F.col("label").cast("string")))
    out = C.permutation_null(edges, own, 10, key)
    return out.select("image_id", "code_1", "code_2", "n", *[rnd(c).alias(c) for c in ("null_mean", "null_std", "fold_change")])


@query(
    f"""WITH c AS (SELECT DISTINCT image_id, label, label % 4 AS code FROM {PIXELS}), e AS MATERIALIZED (SELECT * FROM {_EDGES}), d AS (SELECT image_id, label_1, count(*) AS d FROM e GROUP BY ALL),
g AS (SELECT image_id, sum(d) / 2 AS m, sum(d * (d - 1)) / 2 AS s FROM d GROUP BY 1), z AS (SELECT image_id, code, count(*)::DOUBLE AS k FROM c GROUP BY ALL), t AS (SELECT image_id, sum(k) AS n FROM z GROUP BY 1),
r AS (SELECT a.image_id, a.code AS code_1, b.code AS code_2, a.k AS a, b.k AS b, n, m, s, a.code = b.code AS same FROM z a JOIN z b ON b.image_id = a.image_id JOIN t ON t.image_id = a.image_id JOIN g ON g.image_id = a.image_id),
p AS (SELECT *, CASE WHEN same THEN a * (a - 1) ELSE 2 * a * b END / (n * (n - 1)) AS p1, CASE WHEN same THEN a * (a - 1) * (a - 2) ELSE a * b * (a + b - 2) END / (n * (n - 1) * (n - 2)) AS p2,
  CASE WHEN same THEN a * (a - 1) * (a - 2) * (a - 3) ELSE 4 * a * (a - 1) * b * (b - 1) END / (n * (n - 1) * (n - 2) * (n - 3)) AS p3 FROM r),
q AS (SELECT *, CASE WHEN same THEN 2 ELSE 1 END * m * p1 AS mean, CASE WHEN same THEN 2 ELSE 1 END * sqrt(greatest(0, m * p1 + 2 * s * p2 + (m * (m - 1) - 2 * s) * p3 - m * p1 * m * p1)) AS std FROM p)
SELECT image_id, code_1, code_2, coalesce(o.n, 0) AS n, round(mean, 6) AS null_mean, round(std, 6) AS null_std, round((coalesce(o.n, 0) + 1) / (mean + 1), 6) AS fold_change FROM q LEFT JOIN {_NET} o USING (image_id, code_1, code_2)"""
)
def d38_permutation_moments(spark, d):
    """The null model in closed form: no simulation."""
    out = C.permutation_moments(*_network(spark, d))
    return out.select("image_id", "code_1", "code_2", "n", *[rnd(c).alias(c) for c in ("null_mean", "null_std", "fold_change")])


@query(
    f"""WITH n AS {_NET}, a AS (SELECT code_1, code_2, n / max(n) OVER () AS p FROM n WHERE image_id = 0 AND code_1 <> code_2), b AS (SELECT code_1, code_2, n / max(n) OVER () AS q FROM n WHERE image_id = 1 AND code_1 <> code_2)
SELECT round(sum((coalesce(p, 0) - coalesce(q, 0)) * (coalesce(p, 0) - coalesce(q, 0))), 6) AS distance FROM a FULL JOIN b USING (code_1, code_2)"""
)
def d39_network_distance(spark, d):
    n = C.adjacency_counts(*_network(spark, d))
    return C.network_distance(n.where("image_id = 0"), n.where("image_id = 1")).select(rnd("distance").alias("distance"))


@query(
    f"""WITH n AS {_NET}, a AS (SELECT code_1, code_2, log10(n + 1) AS p FROM n WHERE image_id = 0 AND code_1 <> code_2), b AS (SELECT code_1, code_2, log10(n + 1) AS q FROM n WHERE image_id = 1 AND code_1 <> code_2)
SELECT round(sum((coalesce(p, 0) - coalesce(q, 0)) * (coalesce(p, 0) - coalesce(q, 0))), 6) AS distance FROM a FULL JOIN b USING (code_1, code_2)"""
)
def d39_network_distance_log(spark, d):
    n = C.adjacency_counts(*_network(spark, d))
    return C.network_distance(n.where("image_id = 0"), n.where("image_id = 1"), log=True).select(rnd("distance").alias("distance"))


@query(
    f"""WITH s AS (SELECT event_type, count(n) FILTER (grp = 0) AS a, count(n) FILTER (grp = 1) AS b, avg(n) FILTER (grp = 0) AS ma, avg(n) FILTER (grp = 1) AS mb, var_samp(n) FILTER (grp = 0) AS va, var_samp(n) FILTER (grp = 1) AS vb FROM {_TWO} GROUP BY 1)
SELECT event_type, a + b - 2 AS df, round((ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2) * (1 / a + 1 / b)), 6) AS t, round(ma / mb, 6) AS fold_change FROM s"""
)
def d40_pair_ttest(spark, d):
    out = C.pair_ttest(_two(spark, d), ["event_type"], "grp", "n", (0, 1))
    return out.select("event_type", "df", rnd("t").alias("t"), rnd("fold_change").alias("fold_change"))


@query(
    f"""WITH s AS (SELECT event_type, count(n) FILTER (grp = 0) AS a, count(n) FILTER (grp = 1) AS b, avg(n) FILTER (grp = 0) AS ma, avg(n) FILTER (grp = 1) AS mb, var_samp(n) FILTER (grp = 0) AS va, var_samp(n) FILTER (grp = 1) AS vb FROM {_TWO} GROUP BY 1),
t AS (SELECT event_type, (a + b - 2)::DOUBLE AS df, abs((ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2) * (1 / a + 1 / b))) AS t FROM s),
p AS (SELECT event_type, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (t / 4000) / 3 *
  list_sum(list_transform(range(4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (k * t / 4000) * (k * t / 4000) / df, -(df + 1) / 2)))) AS p FROM t)
SELECT event_type, round(p, 6) + 0.0 AS p_value, p < 0.05 / (SELECT count(*) FROM p) AS significant FROM p"""
)
def d40_pair_ttest_p_values(spark, d):
    """The tail probability against the density summed by Simpson's rule."""
    return C.pair_ttest(_two(spark, d), ["event_type"], "grp", "n", (0, 1)).select("event_type", rnd("p_value").alias("p_value"), "significant")


@query("WITH c AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL) SELECT a.event_type AS i, b.event_type AS j, round(corr(a.v, b.v), 6) + 0.0 AS r, count(*) AS n FROM c a JOIN c b USING (user_id) GROUP BY ALL")
def d41_corr_matrix(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return C.corr_matrix(c, "event_type", "user_id", "v").withColumn("r", rnd("r"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sum(CASE WHEN l_quantity = 0 THEN l_extendedprice ELSE 0 END), 2) AS gross_error FROM lineitem GROUP BY 1")
def d42_regress(spark, d):
    r = C.regress(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return r.select("l_suppkey", rnd("slope", 4).alias("slope"), rnd("intercept", 4).alias("intercept"), rnd("r2").alias("r2"), rnd("gross_error", 2).alias("gross_error"))


@query(
    """WITH n AS (SELECT user_id, ln(value + 1) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT user_id, r, (((i * 48271 + r * 69621 + user_id) * 16807) % 2147483647) % n + 1 AS i FROM n, (SELECT unnest(range(1, 21)) AS r)), m AS (SELECT user_id, r, avg(value) AS m FROM d JOIN n USING (user_id, i) GROUP BY ALL)
SELECT user_id, round(avg(m), 5) AS mean, round(quantile_cont(m, 0.25), 5) AS q25, round(quantile_cont(m, 0.75), 5) AS q75 FROM m GROUP BY user_id"""
)
def d43_bootstrap_mean(spark, d):
    # the draws follow a rule that SQL can repeat; by default they follow a hash
    draw = ((F.col("i") * 48271 + F.col("replicate") * 69621 + F.col("user_id")) * 16807) % 2147483647
    rows = table(spark, d, "events").select("user_id", "event_id", F.log(F.col("value") + 1).alias("value"))
    out = C.bootstrap_mean(rows, ["user_id"], "value", "event_id", 20, draw=draw)
    return out.select("user_id", *[rnd(c, 5).alias(c) for c in ("mean", "q25", "q75")])


@query("SELECT event_type, user_id % 2 AS grp, count(*) AS n, TRUE AS within FROM events WHERE value IS NOT NULL GROUP BY ALL")
def d31_sketch_quantiles(spark, d):
    """Quartiles from one sketch per user, merged by type and group: whether their ranks are within two per cent."""
    e = table(spark, d, "events").select("event_type", "user_id", (F.col("user_id") % 2).alias("grp"), "value")
    merged = C.sketch_quantiles(C.quantile_sketches(e, ["event_type", "grp", "user_id"], "value"), ["event_type", "grp"])
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    ranks = e.join(merged, ["event_type", "grp"]).groupBy("event_type", "grp", "n").agg(*[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(q) for q in shares])
    near = F.lit(True)
    for q, p in shares.items():
        near = near & (F.abs(F.col(q) - p) <= 0.02 + 1 / F.col("n"))
    return ranks.select("event_type", "grp", "n", near.alias("within"))


@query(
    f"""WITH p AS (SELECT a.image_id, a.code, a.x, a.y, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r FROM {CELLS} a JOIN {CELLS} b ON a.image_id = b.image_id AND a.code = b.code AND a.cell <> b.cell),
q AS (SELECT *, round(r / 30)::INT AS k FROM p), w AS (SELECT image_id, code, k, k * 30 AS kr, greatest(0, least(550 - abs(x), 550 - abs(y))) AS e FROM q WHERE k BETWEEN 1 AND 4 AND abs(r - k * 30) < 15),
n AS (SELECT image_id, code, count(*) AS n FROM {CELLS} GROUP BY ALL)
SELECT w.image_id, w.code, k, round(1210000 * sum(CASE WHEN kr >= e THEN 2 * pi() / (2 * pi() - 2 * acos(e / kr)) ELSE 1 END) / (any_value(n) * any_value(n) * 2 * pi() * k * 900), 6) AS g FROM w JOIN n ON n.image_id = w.image_id AND n.code = w.code GROUP BY w.image_id, w.code, k"""
)
def d44_pair_correlation(spark, d):
    return C.pair_correlation(cells(spark, d), 30, 4, 550, 1210000).withColumn("g", rnd("g"))


@query(
    f"""WITH r AS (SELECT image_id, point_id, code, row_number() OVER (PARTITION BY image_id, point_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), cell) AS r FROM {POINTS} JOIN {CELLS} USING (image_id)),
c AS (SELECT image_id, point_id, s AS n_cell, code, count(*) AS n FROM r JOIN (SELECT unnest([10, 40])::INT AS s) ON r <= s GROUP BY ALL),
a AS (SELECT image_id, point_id, n_cell, -sum(p * ln(p)) AS alpha FROM (SELECT *, n / sum(n) OVER (PARTITION BY image_id, point_id, n_cell) AS p FROM c) GROUP BY ALL),
g AS (SELECT image_id, -sum(p * ln(p)) AS gamma FROM (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS p FROM (SELECT image_id, code, count(*) AS n FROM {CELLS} GROUP BY ALL)) GROUP BY 1)
SELECT image_id, n_cell, round(any_value(gamma) / avg(alpha), 6) AS beta FROM a JOIN g USING (image_id) GROUP BY ALL"""
)
def d45_beta_diversity(spark, d):
    return C.beta_diversity(cells(spark, d), points(spark, d), [10, 40]).withColumn("beta", rnd("beta"))


@query(
    f"""WITH r AS (SELECT image_id, point_id, code, row_number() OVER (PARTITION BY image_id, point_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), cell) AS r FROM {POINTS} JOIN {CELLS} USING (image_id)),
c AS (SELECT image_id, point_id, s AS n_cell, code, count(*) AS n FROM r JOIN (SELECT unnest([10, 40])::INT AS s) ON r <= s GROUP BY ALL),
a AS (SELECT image_id, point_id, n_cell, -sum(p * ln(p)) AS alpha FROM (SELECT *, n / sum(n) OVER (PARTITION BY image_id, point_id, n_cell) AS p FROM c) GROUP BY ALL),
g AS (SELECT image_id, -sum(p * ln(p)) AS gamma FROM (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS p FROM (SELECT image_id, code, count(*) AS n FROM {CELLS} GROUP BY ALL)) GROUP BY 1)
SELECT image_id, n_cell, round(avg(CASE WHEN alpha > 0 THEN gamma / alpha END), 6) AS beta FROM a JOIN g USING (image_id) GROUP BY ALL"""
)
def d45_beta_mean_of_ratios(spark, d):
    return C.beta_diversity(cells(spark, d), points(spark, d), [10, 40], mode="mean_of_ratios").withColumn("beta", rnd("beta"))


@query(
    f"""WITH r AS (SELECT image_id, point_id, code, x, y, cell % 5 + 1 AS area, row_number() OVER (PARTITION BY image_id, point_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), cell) AS r FROM {POINTS} JOIN {CELLS} USING (image_id)),
k AS (SELECT * FROM r WHERE r <= 25), c AS (SELECT point_id, code, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT point_id, sum(x * area) / sum(area) AS cx, sum(y * area) / sum(area) AS cy FROM k GROUP BY 1),
q AS (SELECT a.point_id AS p1, b.point_id AS p2 FROM m a JOIN m b ON b.point_id = a.point_id + 4),
u AS (SELECT p1, p2, code, sum(a) AS a, sum(b) AS b FROM (SELECT p1, p2, code, n AS a, 0 AS b FROM q JOIN c ON c.point_id = p1 UNION ALL SELECT p1, p2, code, 0, n FROM q JOIN c ON c.point_id = p2) GROUP BY ALL)
SELECT p1 AS patch_1, p2 AS patch_2, round(sum(abs(a - b)) / sum(a + b), 6) AS dissimilarity, round(any_value(sqrt((x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy))), 6) AS distance FROM u JOIN m x ON x.point_id = p1 JOIN m y ON y.point_id = p2 GROUP BY p1, p2"""
)
def d46_bray_curtis(spark, d):
    near = J.knn_points(points(spark, d), cells(spark, d), 25)
    # read three times
    patches = stored(near.select(F.col("point_id").alias("patch_id"), "code", "x", "y", (F.col("cell") % 5 + 1).alias("area")), "patches")
    ids = patches.select("patch_id").distinct()
    pairs = ids.select(F.col("patch_id").alias("patch_1"), (F.col("patch_id") + 4).alias("patch_2")).join(ids.select(F.col("patch_id").alias("patch_2")), "patch_2", "left_semi")
    out = C.bray_curtis(patches, pairs)
    return out.select("patch_1", "patch_2", rnd("dissimilarity").alias("dissimilarity"), rnd("distance").alias("distance"))


@query(f"WITH g AS (SELECT image_id, floor(x / 50)::BIGINT AS tx, floor(y / 50)::BIGINT AS ty, avg(cos(cell)) AS c, avg(sin(cell)) AS s FROM {CELLS} GROUP BY ALL), m AS (SELECT *, 1.5 * c * c - 0.5 AS a, 1.5 * s * s - 0.5 AS b, 1.5 * c * s - 0.5 AS o FROM g) SELECT image_id, tx, ty, round((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + o * o), 6) + 0.0 AS ord FROM m")
def d47_alignment_order(spark, d):
    out = C.alignment_order(cells(spark, d).withColumn("orientation", F.col("cell").cast("double")), 50)
    return out.select("image_id", "tx", "ty", rnd("order").alias("ord"))


@query("SELECT user_id, count(*) AS cells, count(DISTINCT event_type) AS classes FROM events GROUP BY 1")
def d48_sample_quality(spark, d):
    return summaries.sample_quality(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT source, a.n AS imaging, coalesce(b.n, 0) AS sequencing FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) a LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) b USING (source)")
def d49_compare_sources(spark, d):
    docs = table(spark, d, "documents")
    return summaries.compare_sources(docs, docs.join(table(spark, d, "labels"), "doc_id"), "source")


@query(
    f"""WITH b AS (SELECT k, avg(x) AS b FROM (SELECT unnest(range(64)) AS k, unnest(v) AS x FROM {SPECTRA}) GROUP BY k),
m AS (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS k, unnest(v) AS x FROM {SPECTRA}) GROUP BY ALL)
SELECT label, round(1.2 - 0.01 * greatest(0, ceil(round(max((1.2 * round(b, 9) - round(m, 9) - 0.005) / round(b, 9)) / 0.01, 9))), 6) AS factor FROM m JOIN b USING (k) GROUP BY label"""
)
def d50_background_factor(spark, d):
    s = spectra(spark, d)
    nine = lambda c: F.transform(c, lambda x: F.round(x, 9))
    mean = C.mean_array(s, ["label"], "v").select("label", nine("v").alias("m"))
    all_ = C.mean_array(s.withColumn("one", F.lit(1)), ["one"], "v").select(nine("v").alias("b"))
    return mean.crossJoin(F.broadcast(all_)).select("label", rnd(C.background_factor(F.col("m"), F.col("b"), F.lit(1.2))).alias("factor"))


@query(
    f"""WITH p AS (SELECT vec_id // 50 AS image_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE list_max(v[1:32]) END AS top FROM {SPECTRA}),
l AS (SELECT image_id, avg(top) FILTER (top > 0) AS level FROM p GROUP BY 1),
s AS (SELECT DISTINCT image_id, image_id // 20 AS experiment, (image_id * 37) % 101 AS ts, image_id % 4 = 1 AS flag FROM p),
n AS (SELECT a.image_id, b.image_id AS nearest_id, row_number() OVER (PARTITION BY a.image_id ORDER BY abs(a.ts - b.ts), b.ts) AS r FROM s a JOIN s b ON a.experiment = b.experiment AND b.flag)
SELECT s.image_id, nearest_id, round(CASE WHEN s.flag THEN 1 ELSE l.level / o.level END, 6) AS factor FROM s JOIN l ON l.image_id = s.image_id LEFT JOIN n ON n.image_id = s.image_id AND r = 1 LEFT JOIN l o ON o.image_id = nearest_id"""
)
def d50_background_ratio(spark, d):
    s = spectra(spark, d).select(F.floor(F.col("vec_id") / 50).alias("image_id"), "v", (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    k = F.col("image_id")
    images = s.select("image_id").distinct().select("image_id", F.floor(k / 20).alias("experiment"), (k * 37 % 101).alias("ts"), (k % 4 == 1).cast("int").alias("flag"))
    return C.background_ratio(s, images).withColumn("factor", rnd("factor"))


@query(
    f"""WITH q AS (SELECT vec_id, vec_id // 50 AS image_id, v, vec_id % 3 <> 0 AS mask FROM {SPECTRA}), l AS (SELECT image_id, avg(top) FILTER (top > 0) AS level FROM (SELECT image_id, CASE WHEN mask THEN list_max(v[1:32]) ELSE 0 END AS top FROM q) GROUP BY 1),
s AS (SELECT DISTINCT image_id, image_id // 20 AS experiment, (image_id * 37) % 101 AS ts, image_id % 4 = 1 AS flag FROM q),
n AS (SELECT a.image_id, a.flag, b.image_id AS nearest_id, row_number() OVER (PARTITION BY a.image_id ORDER BY abs(a.ts - b.ts), b.ts) AS r FROM s a JOIN s b ON a.experiment = b.experiment AND b.flag),
f AS (SELECT n.image_id, nearest_id, CASE WHEN n.flag THEN 1 ELSE l.level / o.level END AS start FROM n JOIN l ON l.image_id = n.image_id JOIN l o ON o.image_id = nearest_id WHERE r = 1),
m AS (SELECT image_id, k, avg(v[k]) AS m FROM (SELECT image_id, v, unnest(range(1, 33)) AS k FROM q WHERE mask) GROUP BY ALL), b AS (SELECT image_id, list(m ORDER BY k) AS b FROM m GROUP BY image_id),
g AS (SELECT f.image_id, nearest_id, start - 0.01 * greatest(0, ceil(round(coalesce(max(CASE WHEN o.m > 0 THEN (start * o.m - m.m - 0.005) / o.m END), 0) / 0.01, 9))) AS factor FROM f JOIN m ON m.image_id = f.image_id JOIN m o ON o.image_id = nearest_id AND o.k = m.k GROUP BY f.image_id, nearest_id, start)
SELECT vec_id, round(factor, 6) AS factor, list_transform(range(1, 65), lambda k: round(CASE WHEN k <= 32 AND factor IS NOT NULL THEN v[k] - factor * b[k] ELSE v[k] END, 6) + 0.0) AS n FROM q LEFT JOIN g ON g.image_id = q.image_id LEFT JOIN b ON b.image_id = nearest_id"""
)
def d50_b22_remove_background(spark, d):
    """Ratio, factor and subtraction as one flow over all spectra."""
    s = spectra(spark, d).select("vec_id", F.floor(F.col("vec_id") / 50).alias("image_id"), "v", (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    k = F.col("image_id")
    images = s.select("image_id").distinct().select("image_id", F.floor(k / 20).alias("experiment"), (k * 37 % 101).alias("ts"), (k % 4 == 1).cast("int").alias("flag"))
    return C.remove_background(s, images).select("vec_id", rnd("factor").alias("factor"), F.transform("v", lambda x: F.round(x, 6) + F.lit(0.0)).alias("n"))


@query(f"SELECT x, y, round(m / max(m) OVER (), 6) AS calibration FROM (SELECT x, y, avg(v) AS m FROM {PIXELS} GROUP BY ALL)")
def d51_average_frames(spark, d):
    return C.average_frames(pixels(spark, d)).withColumn("calibration", rnd("calibration"))


@query(f"WITH c AS (SELECT x, y, m / max(m) OVER () AS c FROM (SELECT x, y, avg(v) AS m FROM {PIXELS} GROUP BY ALL)) SELECT image_id, x, y, [round(ln(w[1] + 2) / c, 7), round(ln(w[2] + 2) / c, 7), round(ln(w[3] + 2), 7)] AS w FROM {_PX3} JOIN c USING (x, y)")
def b23_flat_field(spark, d):
    """Log intensities over the frames' average."""
    px = _px3(spark, d)
    logs = px.withColumn("intensity", F.transform("intensity", lambda x: F.log(x + 2)))
    out = C.flat_field(logs, C.average_frames(px, frame="image_id"), "intensity", 2)
    return out.select("image_id", "x", "y", F.transform("intensity", lambda x: rnd_scaled(x, 7)).alias("w"))


@query("SELECT l_linenumber, round(avg(l_extendedprice), 4) AS intensity, count(*) AS n FROM lineitem GROUP BY 1")
def d52_intensity_abundance(spark, d):
    s = summaries.value_summary(table(spark, d, "lineitem"), ["l_linenumber"], "l_extendedprice")
    return s.select("l_linenumber", rnd("mean", 4).alias("intensity"), "n")


@query(
    f"""WITH s AS (SELECT source, string_split({dna_sql('text')}, '') AS q FROM documents), l AS (SELECT source, unnest(range(1, len(q) + 1)) AS k, unnest(q) AS b FROM s WHERE q <> ['']),
c AS (SELECT source, k, b, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT source, k, b, row_number() OVER (PARTITION BY source, k ORDER BY n DESC, b) AS r FROM c)
SELECT source, md5(string_agg(b, '' ORDER BY k)) AS consensus FROM m WHERE r = 1 GROUP BY source"""
)
def d53_consensus(spark, d):
    s = documents(spark, d).select("source", dna("text").alias("seq")).where("seq <> ''")
    return C.consensus(s, "source", "seq").select("source", F.md5("consensus").alias("consensus"))


@query(f"SELECT image_id, code_1 AS code, sum(CASE WHEN code_1 <> code_2 THEN n ELSE 0 END)::BIGINT AS degree FROM {_NET} GROUP BY ALL")
def d55_degree(spark, d):
    return C.degree(C.adjacency_counts(*_network(spark, d)), ["image_id"])


@query(
    """WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS ss, sum(n * v) AS w FROM g)
SELECT round(((ss - s * s / n) / (k - 1)) / (w / (n - k)), 5) AS f, (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2 FROM t"""
)
def d56_anova(spark, d):
    return C.anova(table(spark, d, "events"), "event_type", "value").select(rnd("f", 5).alias("f"), "df1", "df2")


@query(f"SELECT code_1, code_2, round(CASE WHEN a > 0 AND b > 0 THEN log10(a / b) ELSE 0 END, 6) + 0.0 AS log_ratio FROM (SELECT code_1, code_2, avg(n) FILTER (image_id = 0) AS a, avg(n) FILTER (image_id = 1) AS b FROM {_NET} GROUP BY ALL)")
def d57_diff_adjacency(spark, d):
    return C.diff_adjacency(C.adjacency_counts(*_network(spark, d)), "image_id", (0, 1)).withColumn("log_ratio", rnd("log_ratio"))


# -- selections --------------------------------------------------------------------------------


_LI = "(SELECT l_suppkey AS taxon, l_orderkey AS id, l_partkey AS part, l_orderkey % 1500 AS p_start, l_discount AS rate, l_quantity AS q, l_extendedprice AS price FROM lineitem)"
_ORDER = "rate DESC, q, price, id, part"


def li(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("taxon"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), (F.col("l_orderkey") % 1500).alias("p_start"), F.col("l_discount").alias("rate"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"))


def order():
    return [F.desc("rate"), F.asc("q"), F.asc("price"), F.asc("id"), F.asc("part")]


@query(f"SELECT taxon, bin, id, part FROM (SELECT *, row_number() OVER (PARTITION BY taxon, bin ORDER BY {_ORDER}) AS r FROM (SELECT *, p_start // 100 AS bin FROM {_LI}) WHERE bin < 15) WHERE r = 1")
def e01_best_per_bin(spark, d):
    return selection.best_per_bin(li(spark, d), "taxon", "p_start", 100, order()).select("taxon", "bin", "id", "part")


@query(
    f"""WITH r AS (SELECT *, p_start // 500 AS bin, rate > 0.09 AND q > 49 AND price > 60000 AS ok FROM {_LI}), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY taxon) AS any_ok FROM r)
SELECT taxon, id, part, 'bins' AS selection_method FROM (SELECT *, row_number() OVER (PARTITION BY taxon, bin ORDER BY {_ORDER}) AS k FROM a WHERE ok) WHERE k = 1
UNION ALL SELECT taxon, id, part, 'single' FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY {_ORDER}) AS k FROM a WHERE NOT any_ok) WHERE k = 1"""
)
def e02_with_fallback(spark, d):
    rows = li(spark, d).withColumn("bin", S.position_bin("p_start", 500))
    ok = (F.col("rate") > 0.09) & (F.col("q") > 49) & (F.col("price") > 60000)
    return selection.with_fallback(rows, ok, "taxon", order(), order(), "bin", ("bins", "single")).select("taxon", "id", "part", "selection_method")


@query(
    f"""WITH w AS (SELECT *, unnest([120, 100, 80, 60, 40, 20])::INT AS bin_width FROM (SELECT * REPLACE (part % 500 AS taxon) FROM {_LI})), b AS (SELECT *, p_start // bin_width AS bin FROM w WHERE p_start // bin_width < 1500 // bin_width),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY taxon, bin_width, bin ORDER BY {_ORDER}) AS r FROM b) WHERE r = 1),
n AS (SELECT taxon, bin_width, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT taxon, coalesce(max(bin_width) FILTER (n > 15 AND bin_width <= 100) + 20, 20) AS bin_width FROM n GROUP BY taxon)
SELECT taxon, bin_width, bin, id, part FROM f JOIN c USING (taxon, bin_width)"""
)
def e03_adaptive_bins(spark, d):
    return selection.adaptive_bins(li(spark, d).withColumn("taxon", F.col("part") % 500), "taxon", "p_start", order()).select("taxon", "bin_width", "bin", "id", "part")


@query(f"WITH a AS (SELECT *, rate > 0.09 AND q > 49 AS ok, bool_or(rate > 0.09 AND q > 49) OVER (PARTITION BY taxon) AS any_ok, row_number() OVER (PARTITION BY taxon ORDER BY {_ORDER}) AS r FROM {_LI}) SELECT taxon, id, part FROM a WHERE ok OR (NOT any_ok AND r = 1)")
def e04_all_specific(spark, d):
    return selection.all_specific(li(spark, d), (F.col("rate") > 0.09) & (F.col("q") > 49), "taxon", order()).select("taxon", "id", "part")


@query(f"WITH a AS (SELECT *, rate > 0.05 AND q > 40 AS ok FROM {_LI}), b AS (SELECT *, bool_or(ok) OVER (PARTITION BY taxon) AS any_ok, row_number() OVER (PARTITION BY taxon ORDER BY ok DESC, {_ORDER}) AS r FROM a) SELECT taxon, id, part FROM b WHERE (ok AND r <= 5) OR (NOT any_ok AND r = 1)")
def e05_top_n(spark, d):
    return selection.top_n(li(spark, d), (F.col("rate") > 0.05) & (F.col("q") > 40), "taxon", order(), 5).select("taxon", "id", "part")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def e06_single_best(spark, d):
    return selection.first_of(table(spark, d, "part"), ["p_brand"], [F.asc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


@query("SELECT l_suppkey, l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def e07_first_per_group(spark, d):
    return selection.first_of(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], [F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_extendedprice")]).select("l_suppkey", "l_linenumber", "l_orderkey")


@query(
    """WITH r AS (SELECT DISTINCT l_partkey % 200 AS key, l_linenumber AS e, l_suppkey AS c FROM lineitem),
g AS (SELECT key, c, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT key, arg_min(c, (-n, c)) AS c FROM g GROUP BY key),
l AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM r x JOIN f ON f.key = x.key AND f.c = x.c WHERE x.key = r.key AND x.e = r.e)),
h AS (SELECT key, arg_min(c, (-n, c)) AS c FROM (SELECT key, c, count(*) AS n FROM l GROUP BY ALL) GROUP BY key)
SELECT r.key, count(DISTINCT e) AS elements, count(DISTINCT e) AS covered, any_value(f.c) AS first_choice, any_value(h.c) AS second_choice FROM r JOIN f ON f.key = r.key LEFT JOIN h ON h.key = r.key GROUP BY r.key"""
)
def e08_min_cover(spark, d):
    """The greedy cover: every element of a key is covered by a chosen supplier; its first two choices."""
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("key"), F.col("l_linenumber").alias("element"), F.col("l_suppkey").alias("choice"))
    chosen = selection.min_cover(rows, "key", "element", "choice", stored)
    covered = rows.join(chosen, ["key", "choice"]).groupBy("key").agg(F.count_distinct("element").alias("covered"))
    taken = lambda k: F.max(F.when(F.col("round") == k, F.col("choice")))
    first = chosen.groupBy("key").agg(taken(1).alias("first_choice"), taken(2).alias("second_choice"))
    return rows.groupBy("key").agg(F.count_distinct("element").alias("elements")).join(covered, "key").join(first, "key").select("key", "elements", "covered", "first_choice", "second_choice")


@query(
    """WITH RECURSIVE s AS (SELECT key, c, list(DISTINCT e) AS es FROM (SELECT l_partkey % 200 AS key, l_linenumber AS e, l_suppkey AS c FROM lineitem) GROUP BY ALL),
w AS (SELECT key, list(DISTINCT e) AS es FROM (SELECT l_partkey % 200 AS key, l_linenumber AS e FROM lineitem) GROUP BY key),
g AS (SELECT key, 0 AS round, NULL::BIGINT AS choice, es AS rest FROM w
  UNION ALL SELECT key, round + 1, b.c, list_filter(rest, lambda x: NOT list_contains(b.es, x)) FROM
    (SELECT g.key, g.round, g.rest, min(struct_pack(n := -len(list_filter(s.es, lambda x: list_contains(g.rest, x))), c := s.c, es := s.es)) AS b FROM g JOIN s ON s.key = g.key WHERE len(g.rest) > 0 GROUP BY ALL))
SELECT key, round, choice FROM g WHERE round > 0"""
)
def e08_cover_rounds(spark, d):
    """All choices of the greedy cover, in the order taken."""
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("key"), F.col("l_linenumber").alias("element"), F.col("l_suppkey").alias("choice"))
    return selection.min_cover(rows, "key", "element", "choice", stored).select("key", F.col("round").cast("int").alias("round"), F.col("choice").cast("long").alias("choice"))


@query(
    """WITH RECURSIVE r AS (SELECT DISTINCT l_suppkey % 10 AS taxon, (l_orderkey % 1500) // 500 AS bin, l_linenumber * 10 + l_orderkey % 7 AS e, l_partkey % 40 AS c FROM lineitem),
s AS (SELECT taxon, bin, c, list(e) AS es FROM r GROUP BY ALL), w AS (SELECT taxon, bin, list(DISTINCT e) AS es FROM r GROUP BY ALL),
g AS (SELECT taxon, bin, 0 AS round, NULL::BIGINT AS choice, es AS rest FROM w
  UNION ALL SELECT taxon, bin, round + 1, b.c, list_filter(rest, lambda x: NOT list_contains(b.es, x)) FROM
    (SELECT g.taxon, g.bin, g.round, g.rest, min(struct_pack(n := -len(list_filter(s.es, lambda x: list_contains(g.rest, x))), c := s.c, es := s.es)) AS b FROM g JOIN s ON s.taxon = g.taxon AND s.bin = g.bin WHERE len(g.rest) > 0 GROUP BY ALL))
SELECT taxon, bin, round, choice FROM g WHERE round > 0"""
)
def e08_cover_per_bin(spark, d):
    """The greedy cover of each taxon's molecules within every position bin."""
    order_ = F.col("l_orderkey")
    key = F.struct((F.col("l_suppkey") % 10).alias("taxon"), F.floor(order_ % 1500 / 500).alias("bin"))
    rows = table(spark, d, "lineitem").select(key.alias("key"), (F.col("l_linenumber") * 10 + order_ % 7).alias("element"), (F.col("l_partkey") % 40).alias("choice"))
    return selection.min_cover(rows, "key", "element", "choice", stored).select("key.taxon", "key.bin", F.col("round").cast("int").alias("round"), F.col("choice").cast("long").alias("choice"))


@query()
def e08_cover_quality(spark, d):
    """Suppliers that cover a nation's parts, by region of the order's customer: greedy size, size without redundant ones, and a bound for any cover."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = stored(rows.select(F.col("c_nationkey").alias("key"), (F.col("l_partkey") % 97).alias("element"), F.col("l_suppkey").alias("choice")).distinct(), "cover")
    # three steps read the pairs, which are joined once
    chosen = selection.min_cover(rows, "key", "element", "choice", stored)
    kept = selection.without_redundant(rows, chosen, "key", "element", "choice", stored)
    size = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    return size(chosen, "greedy_size").join(size(kept, "size"), "key").join(selection.cover_bound(rows, chosen, "key", "element", "choice"), "key")


@query("WITH t AS (SELECT DISTINCT p_partkey::VARCHAR AS taxon FROM part ORDER BY 1 LIMIT 127), r AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS k FROM t), c AS (SELECT n, row_number() OVER (ORDER BY bit_count(n), n) AS k FROM (SELECT unnest(range(1, 128))::BIGINT AS n)) SELECT taxon, n AS number, lpad(bin(n), 7, '0') AS code FROM r JOIN c USING (k)")
def e09_assign_barcodes(spark, d):
    return selection.assign_barcodes(table(spark, d, "part").select(F.col("p_partkey").alias("taxon")), spark, 7, "simple")


@query("WITH t AS (SELECT DISTINCT p_partkey::VARCHAR AS taxon FROM part ORDER BY 1 LIMIT 127), r AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS k FROM t), c AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, 128))::BIGINT AS n)) SELECT taxon, n AS number, lpad(bin(n), 7, '0') AS code FROM r JOIN c USING (k)")
def e09_sequential(spark, d):
    return selection.assign_barcodes(table(spark, d, "part").select(F.col("p_partkey").alias("taxon")), spark, 7, "sequential")


@query("WITH t AS (SELECT DISTINCT p_partkey::VARCHAR AS taxon FROM part ORDER BY 1 LIMIT 127), r AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS k FROM t), c AS (SELECT n, row_number() OVER (ORDER BY -bit_count(n), n) AS k FROM (SELECT unnest(range(1, 128))::BIGINT AS n)) SELECT taxon, n AS number, lpad(bin(n), 7, '0') AS code FROM r JOIN c USING (k)")
def e09_complex(spark, d):
    return selection.assign_barcodes(table(spark, d, "part").select(F.col("p_partkey").alias("taxon")), spark, 7, "complex")


@query("SELECT count(*) AS taxa, count(*) AS codes, 1 AS least, 127 AS largest FROM (SELECT DISTINCT p_partkey FROM part ORDER BY p_partkey::VARCHAR LIMIT 127)")
def e09_random(spark, d):
    """Random codes: each taxon has one, none twice."""
    out = selection.assign_barcodes(table(spark, d, "part").select(F.col("p_partkey").alias("taxon")), spark, 7, "random")
    return out.agg(F.count_distinct("taxon").alias("taxa"), F.count_distinct("code").alias("codes"), F.min("number").cast("int").alias("least"), F.max("number").cast("int").alias("largest"))


@query(f"WITH r AS (SELECT taxon, row_number() OVER w AS i, sum(q) OVER (PARTITION BY taxon ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS c FROM {_LI} WINDOW w AS (PARTITION BY taxon ORDER BY {_ORDER})) SELECT taxon, arg_max(c, i) AS total, max(c) FILTER (i = 10) AS at_10, max(c) FILTER (i = 20) AS at_20 FROM r GROUP BY taxon")
def e10_cumulative_coverage(spark, d):
    return selection.cumulative_coverage(li(spark, d), "taxon", "q", order())


@query(f"SELECT cell, arg_min(c, (d, r)) AS code, round(min(d), 6) AS dist FROM (SELECT vec_id // 5 AS cell, vec_id % 5 AS r, CASE WHEN label < 8 THEN lpad(bin(label::BIGINT), 7, '0') ELSE '0000000' END AS c, CASE WHEN label < 8 THEN v[1] ELSE 1.0 END AS d FROM {SPECTRA}) GROUP BY cell")
def e11_replicate_consensus(spark, d):
    s = spectra(spark, d).select(F.floor(F.col("vec_id") / 5).alias("cell"), (F.col("vec_id") % 5).alias("r"), F.when(F.col("label") < 8, S.to_bits("label", 7)).alias("code"), F.col("v")[0].alias("dist"))
    return selection.replicate_consensus(s, ["cell"], "code", "dist", "r").withColumn("dist", rnd("dist"))


@query(f"SELECT code_1 AS code, round(sum(abs(log2(n / 5.0))), 6) AS weight FROM {_NET} GROUP BY 1 ORDER BY round(sum(abs(log2(n / 5.0))), 9) DESC, 1 LIMIT 3")
def e12_rank_classes(spark, d):
    n = C.adjacency_counts(*_network(spark, d)).withColumn("fc", F.log2(F.col("n") / 5.0))
    return selection.rank_classes(n, "code_1", "code_2", "fc", 3).withColumn("weight", rnd("weight"))


@query(f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_max(v) DESC, vec_id) AS r FROM {SPECTRA}) WHERE r <= 8")
def e13_top_cells(spark, d):
    s = spectra(spark, d).withColumn("top", F.array_max("v"))
    return selection.first_of(s, ["label"], [F.desc("top"), F.asc("vec_id")], 8).select("label", "vec_id")


_WEIGHTS = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in selection.smoothing_table()) + "]"


@query(
    f"""WITH w AS (SELECT {_WEIGHTS} AS w), a AS (SELECT event_id, list(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT *, CASE WHEN i < 20 THEN i WHEN n - 1 - i < 20 THEN 40 - (n - 1 - i) ELSE 20 END AS p FROM a), b AS (SELECT *, i - p - greatest(0, i - 40) AS s FROM p)
SELECT event_id, CASE WHEN n >= 41 THEN round(greatest(0, least(1, list_dot_product(x[s + 1:s + 41], w[p + 1]))), 6) + 0.0 END AS smoothed FROM b, w"""
)
def e14_smooth(spark, d):
    e = table(spark, d, "events").withColumn("hit", (F.col("event_type") == "click").cast("double"))
    return selection.smooth(e, ["user_id"], [F.asc("value"), F.asc("event_id")], "hit").select("event_id", rnd("smoothed").alias("smoothed"))


@query("SELECT p_brand, p_partkey, 'BP_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS name FROM part")
def e15_name_rows(spark, d):
    return selection.name_rows(table(spark, d, "part"), "BP", ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "name")


@query("SELECT p_brand, p_retailprice, p_partkey FROM part ORDER BY p_brand, p_retailprice, p_partkey")
def e16_quality_sort(spark, d):
    return table(spark, d, "part").select("p_brand", "p_retailprice", "p_partkey").orderBy("p_brand", "p_retailprice", "p_partkey")


# -- sets and shapes ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def f01_union_all(spark, d):
    o = table(spark, d, "orders")
    return J.union_all(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def f02_union_helpers(spark, d):
    t = table(spark, d, "lineitem")
    return J.union_all(*[t.where(c).select("l_orderkey", "l_linenumber") for c in ("l_quantity < 5", "l_quantity > 45")])


@query("SELECT user_id FROM events WHERE event_type = 'click' AND value > 90 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def f03_common_classes(spark, d):
    of = lambda k: table(spark, d, "events").where(f"event_type = '{k}' AND value > 90").select("user_id")
    return of("click").intersect(of("error"))


@query("SELECT l_suppkey AS id FROM lineitem UNION SELECT l_linenumber FROM lineitem")
def f04_union_distinct(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("id")).union(t.select(F.col("l_linenumber").cast("long"))).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_custkey <> 0 EXCEPT ALL SELECT l_orderkey FROM lineitem WHERE l_quantity > 30")
def f05_except(spark, d):
    return table(spark, d, "orders").where("o_custkey <> 0").select("o_orderkey").exceptAll(table(spark, d, "lineitem").where("l_quantity > 30").select("l_orderkey"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def f06_pivot_unpivot(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return wide.unpivot("user_id", kinds, "event_type", "n").where("n IS NOT NULL")


@query("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type, floor(value / 25) AS t FROM events) GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT floor(value / 25)) FROM events)")
def f07_present_everywhere(spark, d):
    e = table(spark, d, "events").withColumn("t", F.floor(F.col("value") / 25))
    return C.present_everywhere(e, ["user_id", "event_type"], "t")


# -- assembly ----------------------------------------------------------------------------------


_READOUTS = [(k, "ACGTTGCAAGCT"[k:] + "GATC"[: k % 4]) for k in range(1, 8)]
_RB = ", ".join(f"({k}, '{s}')" for k, s in _READOUTS)


@query(
    f"""WITH r AS (SELECT * FROM (VALUES {_RB}) t(b, s)), o AS (SELECT p_partkey, lpad(bin(p_partkey % 127 + 1), 7, '0') AS c, {dna_sql('p_name')} AS q FROM part),
k AS (SELECT *, list_filter(range(1, 8), lambda i: c[i] = '1') AS bits FROM o) SELECT p_partkey, 'AAAA' || x.s || q || coalesce(y.s, 'TT') || 'CCCC' AS full_seq FROM k JOIN r x ON x.b = bits[1] LEFT JOIN r y ON y.b = bits[2]"""
)
def b16_assemble(spark, d):
    readouts = spark.createDataFrame(_READOUTS, "bit int, readout string")
    o = table(spark, d, "part").select("p_partkey", S.to_bits(F.col("p_partkey") % 127 + 1, 7).alias("code"), dna("p_name").alias("seq"))
    return probes.assemble(o, readouts, "AAAA", "CCCC", "TT").select("p_partkey", F.col("full").alias("full_seq"))


@query(f"SELECT p_partkey, 'AAAA' || q || CASE length(q) WHEN 7 THEN 'TTT' WHEN 8 THEN 'TT' ELSE 'T' END || 'CCCC' AS full_seq FROM (SELECT p_partkey, {dna_sql('p_name')} AS q FROM part)")
def b17_wrap_blocking(spark, d):
    o = table(spark, d, "part").select("p_partkey", dna("p_name").alias("seq"))
    return probes.wrap_blocking(o, "AAAA", "CCCC", {7: "TTT", 8: "TT"}, "T").select("p_partkey", F.col("full").alias("full_seq"))
