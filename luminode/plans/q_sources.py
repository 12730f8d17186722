"""Queries of the readers and writers (inventory 2.1): given tables go out in each format and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import joins as J
from luminode.plans.base import CELLS, PIXELS, SPECTRA, cells, dna, dna_sql, documents, pixels, query, rnd, sequences, spectra, table
from luminode.plans.q_joins import _BLOCKED, _COS, _MEANS, _REF, references, tree
from luminode.sources import files
from luminode.sources.shared import new_path, stored


@query("SELECT p_partkey::VARCHAR AS design_id, p_brand AS sample, p_size AS max_continuous_homology, round(p_retailprice / 10, 4) AS min_tm FROM part")
def a01_designs(spark, d):
    given = {"design_id": F.col("p_partkey"), "sample": F.col("p_brand"), "max_continuous_homology": F.col("p_size"), "min_tm": rnd(F.col("p_retailprice") / 10, 4)}
    names = files.schema_of(files.DESIGN).names
    path = new_path(spark, "designs")
    table(spark, d, "part").select(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names]).write.option("header", True).csv(path)
    return files.read_designs(spark, path).select("design_id", "sample", "max_continuous_homology", "min_tm")


_SEQS = f"(SELECT 'm' || doc_id AS molecule_id, {dna_sql('text')} AS seq FROM documents)"


@query(f"SELECT molecule_id, length(seq) AS n, md5(seq) AS digest FROM {_SEQS}")
def a02_a09_fasta(spark, d):
    path = new_path(spark, "fasta")
    files.write_fasta(documents(spark, d).select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("molecule_id"), dna("text").alias("seq")), path)
    return files.read_fasta(spark, path).select("molecule_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(f"SELECT md5(seq) AS digest, count(DISTINCT lang) AS n FROM (SELECT coalesce(lang, '') AS lang, {dna_sql('text')} AS seq FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def a09_distinct_by(spark, d):
    """Distinct sequences of each language, a folder for each: how many languages have a sequence."""
    path = new_path(spark, "fasta")
    docs = documents(spark, d).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("molecule_id"), dna("text").alias("seq"), "lang")
    files.write_fasta(docs, path, by=("lang",), distinct=True)
    return files.read_fasta(spark, path).groupBy(F.md5("seq").alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT l_partkey::VARCHAR AS molecule_id, l_orderkey::VARCHAR AS reference_id, l_discount AS pid, l_linenumber AS length, l_tax AS evalue, l_suppkey || ';' || l_linenumber AS staxids FROM lineitem")
def a03_hits(spark, d):
    path = new_path(spark, "hits")
    zero = F.lit(0)
    li = table(spark, d, "lineitem")
    li.select("l_partkey", "l_orderkey", "l_discount", "l_quantity", "l_linenumber", *[zero.alias(f"z{k}") for k in range(6)], "l_tax", "l_extendedprice", F.concat_ws(";", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))).write.option("sep", "\t").csv(path)
    return files.read_hits(spark, path, "molecule").select("molecule_id", "reference_id", "pid", "length", "evalue", "staxids")


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE 'H' END AS rec_type, p_partkey::INT AS cluster_num, p_brand AS query_label FROM part WHERE p_size > 10")
def a04_clusters(spark, d):
    path = new_path(spark, "clusters")
    star = F.lit("*")
    kind = F.when(F.col("p_size") <= 10, "C").when(F.col("p_partkey") % 3 == 0, "S").otherwise("H")
    table(spark, d, "part").select(kind, "p_partkey", "p_size", "p_retailprice", star, star, star, star, "p_brand", star).write.option("sep", "\t").csv(path)
    return files.read_clusters(spark, path).select("rec_type", "cluster_num", "query_label")


@query(f"SELECT p_partkey::INT AS probe_id, {dna_sql('p_name')} AS seq, p_size AS p_start, p_retailprice AS tm FROM part")
def a05_candidates(spark, d):
    path = new_path(spark, "candidates")
    p = table(spark, d, "part")
    fields = ["p_partkey", dna("p_name"), "p_size", "p_size", F.lit(0), F.lit(0.5), "p_retailprice", *[F.lit(0.0)] * 4]
    body = p.select(F.concat(F.lit("   "), F.concat_ws("  ", *[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields])).alias("value"))
    head = table(spark, d, "region").select(F.explode(F.array(F.lit("ACCEPTABLE OLIGOS"), F.lit("  #  seq"), F.lit("====="))).alias("value"))
    head.union(body).write.text(path)
    return files.read_candidates(spark, path).select("probe_id", "seq", "p_start", "tm")


@query("SELECT 'nation' || c_nationkey AS taxon, c_custkey AS id, c_acctbal AS v FROM customer")
def a06_keyed(spark, d):
    path = new_path(spark, "keyed")
    table(spark, d, "customer").select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("taxon"), "c_custkey", "c_acctbal").write.partitionBy("taxon").csv(path)
    return files.read_keyed(spark, path, "taxon=([^/]+)/", "id LONG, v DOUBLE", "taxon")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def a07_partitioned(spark, d):
    path = new_path(spark, "partitioned")
    files.write_partitioned(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"), path, ["l_returnflag", "l_linestatus"])
    return spark.read.parquet(path).where("l_returnflag = 'A' AND l_linestatus = 'F'").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def a07_bucketed(spark, d):
    """Two tables in buckets by customer: their join reads bucket by bucket, without an exchange."""
    names = [new_path(spark, name) for name in ("bucketed_orders", "bucketed_customers")]
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    left, right = (files.write_bucketed(r, path.rsplit("/", 1)[1].replace("-", "_"), ["k"], 8, path) for r, path in zip(rows, names))
    return left.join(right.hint("merge"), "k").select("o_orderkey", "o_totalprice", "c_nationkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def a08_csv(spark, d):
    path = new_path(spark, "csv")
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.schema("c_custkey LONG, c_name STRING, c_acctbal DOUBLE").option("header", True).csv(path)


@query(f"SELECT seq, count(*) AS n FROM (SELECT {dna_sql('p_name')} AS seq FROM part UNION ALL SELECT {dna_sql('c_mktsegment')} FROM customer UNION ALL SELECT {dna_sql('n_name')} FROM nation) GROUP BY 1")
def a10_pool(spark, d):
    path = new_path(spark, "pool")
    files.write_pool(path, *[table(spark, d, t).select(dna(c).alias("seq")) for t, c in (("part", "p_name"), ("customer", "c_mktsegment"), ("nation", "n_name"))])
    return spark.read.text(path).groupBy(F.col("value").alias("seq")).agg(F.count("*").alias("n"))


@query(f"SELECT 'BP_' || p_partkey AS name, {dna_sql('p_name')} AS sequence, CASE WHEN p_size <= 25 THEN '25nm' ELSE '100nm' END AS amount, CASE WHEN p_size <= 25 THEN 'STD' ELSE 'PAGE' END AS purification, length({dna_sql('p_name')})::INT AS length FROM part")
def a11_order_form(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("BP_"), F.col("p_partkey").cast("string")).alias("id"), dna("p_name").alias("seq"), "p_size")
    path = new_path(spark, "order")
    files.write_order_form(p, path, "id", "seq", *S.order_tier("p_size", 25))
    return spark.read.schema("name STRING, sequence STRING, amount STRING, purification STRING, length INT").option("header", True).csv(path)


@query(f"SELECT vec_id, list_transform(v, lambda x: round(x, 6)) AS v FROM {SPECTRA}")
def a12_spectra(spark, d):
    path = new_path(spark, "spectra")
    spectra(spark, d).select("vec_id", *[F.col("v")[k].alias(f"c{k}") for k in range(64)]).write.csv(path)
    return files.read_spectra(spark, path, 64, "vec_id LONG").select("vec_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("SELECT c_name AS sample, c_mktsegment AS treatment, c_nationkey AS sampling_day_reference FROM customer")
def a13_images(spark, d):
    given = {"sample": "c_name", "treatment": "c_mktsegment", "sampling_day_reference": "c_nationkey"}
    path = new_path(spark, "images")
    table(spark, d, "customer").select(*[F.col(given[n]).alias(n) if n in given else F.lit(None).cast("string").alias(n) for n in files.schema_of(files.IMAGES).names]).write.option("header", True).csv(path)
    return files.read_images(spark, path).select("sample", "treatment", "sampling_day_reference")


@query(f"SELECT x, y, label, round(v, 6) AS v FROM {PIXELS} WHERE image_id = 1")
def a14_pixels(spark, d):
    path = new_path(spark, "pixels")
    files.write_partitioned(pixels(spark, d).select("image_id", "x", "y", "label", F.array("v").alias("intensity")), path, ["image_id"])
    return files.read_pixels(spark, path, 1).select("x", "y", "label", rnd(F.col("intensity")[0]).alias("v"))


@query("SELECT code AS code, " + ", ".join(f"count(*) FILTER (image_id = {k}) AS i{k}" for k in range(4)) + f" FROM {CELLS} GROUP BY code")
def a15_matrix(spark, d):
    long = cells(spark, d).groupBy("code", "image_id").agg(F.count("*").alias("n"))
    path = new_path(spark, "matrix")
    files.write_matrix(long, path, "code", "image_id", "n", [0, 1, 2, 3])
    back = spark.read.schema("code INT, " + ", ".join(f"i{k} LONG" for k in range(4))).option("header", True).option("enforceSchema", True).csv(path)
    return back


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a16_pending(spark, d):
    return files.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT 'c' || c_custkey AS taxid, 'n' || c_nationkey AS parent, 'species' AS rank, 'c' || c_custkey AS name FROM customer")
def a17_taxonomy(spark, d):
    path = new_path(spark, "taxonomy")
    tree(spark, d).withColumn("name", F.col("taxid")).write.parquet(path)
    return files.read_taxonomy(spark, path).where("rank = 'species'")


@query("SELECT l_partkey, arg_max(l_orderkey, l_orderkey) AS last_order, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def u01_group_function(spark, d):
    """The hook for users' group functions, which native aggregates replace inside the library."""
    from luminode.operators import models

    def summarise(pdf):
        return pdf.groupby("l_partkey", as_index=False).agg(last_order=("l_orderkey", "max"), mean=("l_quantity", "mean"))

    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    return models.apply_groups(rows, ["l_partkey"], summarise, "l_partkey long, last_order long, mean double", together=True).withColumn("mean", rnd("mean"))


@query("SELECT l_returnflag, l_linestatus, max(l_orderkey) AS last_order, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def u01_mergeable_group_function(spark, d):
    """Four groups that hold the whole table: a user's function on stretches of them, and another that merges what it gives."""
    import pandas as pd

    from luminode.operators import models

    keys = ["l_returnflag", "l_linestatus"]

    def partial(pdf):
        return pdf.groupby(keys, as_index=False).agg(last_order=("l_orderkey", "max"), total=("l_quantity", "sum"), n=("l_quantity", "count"))

    def combine(pdf, last):
        merged = pdf.groupby(keys, as_index=False).agg(last_order=("last_order", "max"), total=("total", "sum"), n=("n", "sum"))
        return pd.DataFrame({**merged[[*keys, "last_order"]], "mean": merged["total"] / merged["n"], "n": merged["n"]}) if last else merged

    rows = table(spark, d, "lineitem").select(*keys, "l_orderkey", "l_quantity")
    kinds = "l_returnflag string, l_linestatus string, last_order long"
    out = models.apply_groups(rows, keys, partial, f"{kinds}, mean double, n long", combine, f"{kinds}, total double, n long", rows=2000)
    return out.withColumn("mean", rnd("mean"))


@query(f"SELECT doc_id, length(q) - length(translate(q, 'GC', '')) AS gc FROM (SELECT doc_id, {dna_sql('text')} AS q FROM documents)")
def u02_row_function(spark, d):
    """The hook for users' row functions with a declared result."""
    from luminode.operators import models

    rows = documents(spark, d).select("doc_id", dna("text").alias("seq"))
    return models.apply_rows(rows, "gc", "long", lambda seq: seq.str.count("[GC]"), "seq").select("doc_id", "gc")


_TRAIN = f"(SELECT vec_id, lpad(bin(label::BIGINT), 7, '0') AS code, list_transform(v, lambda x: round(x / list_max(v), 6)) AS n FROM {SPECTRA})"


@query(f"SELECT * FROM {_TRAIN}")
def u05_training_set(spark, d):
    from luminode.operators import models

    named = spectra(spark, d).withColumn("file", F.concat(F.lit("run/enc_"), F.col("label").cast("string"), F.lit("_avgint.csv")))
    return models.training_set(named, "file", "v", 7).select("vec_id", "code", F.transform("v", lambda x: F.round(x, 6)).alias("n"))


def _features(spark, d):
    return spectra(spark, d).select("vec_id", "label", "v")


@query()
def u04_forest(spark, d):
    from luminode.operators import models

    return models.cross_classify(_features(spark, d), "vec_id", "label", "v", "forest").select("vec_id", "label", "prediction")


@query()
def u04_linear_margin(spark, d):
    from luminode.operators import models

    return models.cross_classify(_features(spark, d), "vec_id", "label", "v", "margin").select("vec_id", "label", "prediction")


@query()
def u06_class_probability(spark, d):
    from luminode.operators import models

    return models.probability_summary(models.cross_classify(_features(spark, d), "vec_id", "label", "v", "forest"), ["label"])


@query()
def u06_probability_profile(spark, d):
    """Class probability against a cell's largest intensity."""
    from luminode.operators import models

    rows = models.cross_classify(_features(spark, d), "vec_id", "label", "v", "forest")
    return models.probability_profile(rows.withColumn("max_intensity", F.array_max("v")), "max_intensity", 0.02)


@query(
    f"""WITH d AS (SELECT vec_id, r.label AS code, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN s.v[i] + r.v[i] = 0 THEN 0.0 ELSE (s.v[i] - r.v[i]) * (s.v[i] - r.v[i]) / (s.v[i] + r.v[i]) END)), 9) AS dist FROM {SPECTRA} s, {_MEANS} r WHERE r.replicate = 0)
SELECT vec_id, arg_min(code, (dist, code)) AS code, round(min(dist), 6) AS distance FROM d GROUP BY vec_id"""
)
def u03_metric_hook(spark, d):
    """A user's metric (chi-square) in the nearest-neighbour classifier: all spectra against the class means."""
    s = spectra(spark, d).withColumn("flags", F.lit(1))
    ref = references(spark, d).where("replicate = 0").select(F.col("label").alias("code"), F.lit(1).alias("flags"), F.col("v").alias("ref_v"))
    out = J.nn_classify(s, ref, lambda a, b: F.round(S.chi2_distance(a, b), 9), "vec_id")
    return out.select("vec_id", "code", rnd("distance").alias("distance"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def s02_running_abundance(spark, d):
    from luminode.streaming import incremental

    return incremental.run_abundance(spark, f"{d}/events.parquet", ["user_id"], "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def s02_daily_abundance(spark, d):
    """Counts by day: a day's state is freed once the stream is a day past it."""
    from luminode.streaming import incremental

    counts = incremental.run_abundance(spark, f"{d}/events.parquet", [], "event_type", "ts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, count(*)::INT AS richness, round(-sum(p * ln(p)), 6) + 0.0 AS shannon, round(1 / sum(p * p), 6) AS inverse_simpson FROM p GROUP BY user_id"""
)
def s02_running_diversity(spark, d):
    """Diversity after each batch of arriving files; here after the last."""
    from luminode.streaming import incremental

    path = new_path(spark, "arriving_events")
    table(spark, d, "events").select("user_id", "event_type").repartition(4).write.parquet(path)
    each = incremental.run_diversity(spark, path, ["user_id"], "event_type", files_per_batch=2)
    last = each.groupBy("user_id").agg(F.max_by(F.struct("richness", "shannon", "inverse_simpson"), "batch").alias("s"))
    return last.select("user_id", F.col("s.richness").cast("int").alias("richness"), rnd("s.shannon").alias("shannon"), rnd("s.inverse_simpson").alias("inverse_simpson"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, sum(n)::BIGINT AS n, count(*)::INT AS richness, round(-sum(p * ln(p)), 6) + 0.0 AS shannon, round(1 / sum(p * p), 6) AS inverse_simpson FROM p GROUP BY user_id"""
)
def s02_diversity_by_key(spark, d):
    """Running diversity from a state by key; each key's last row."""
    from luminode.streaming import incremental

    path = new_path(spark, "arriving_events")
    table(spark, d, "events").select("user_id", "event_type").repartition(4).write.parquet(path)
    changes = incremental.diversity_by_key(spark, path, ["user_id"], "event_type", new_path(spark, "diversity_state"), files_per_batch=2)
    return incremental.last_of(changes, ["user_id"]).select("user_id", "n", "richness", rnd("shannon").alias("shannon"), rnd("inverse_simpson").alias("inverse_simpson"))


@query(
    f"""WITH r AS MATERIALIZED (SELECT * FROM {_REF} WHERE replicate = 0), n AS (SELECT vec_id, code, {_COS} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY round({_COS}, 9), code) AS k FROM {_BLOCKED} JOIN r USING (f))
SELECT s.vec_id, coalesce(code, (SELECT min(code) FROM r)) AS code, round(round(coalesce(dist, 1.0), 9), 6) + 0.0 AS distance FROM {SPECTRA} s LEFT JOIN n ON n.vec_id = s.vec_id AND k = 1"""
)
def s01_classify_stream(spark, d):
    from luminode.plans.q_functions import GATE, THRESHOLDS
    from luminode.streaming import incremental

    path = new_path(spark, "arrivals")
    spectra(spark, d).select("vec_id", "v").repartition(4).write.parquet(path)
    gate = S.gate("v", GATE, THRESHOLDS)
    ref = references(spark, d).where("replicate = 0").select(F.col("label").alias("code"), gate.alias("flags"), F.col("v").alias("ref_v"))
    out = incremental.classify_stream(spark, path, ref, lambda a, b: F.round(S.cosine(a, b), 9), gate)
    return out.select("vec_id", "code", rnd("distance").alias("distance"))


@query()
def d54_cluster(spark, d):
    from luminode.operators import models

    return models.cluster(sequences(documents(spark, d)), "doc_id", "seq", 0.8)


@query()
def d54_greedy_centroids(spark, d):
    """Clusters around centroids: the longest sequence first, each other one joins the first centroid that is similar enough."""
    from luminode.operators import greedy

    return greedy.greedy_clusters(sequences(documents(spark, d)), "doc_id", "seq", 0.8)


@query()
def d53_cluster_consensus(spark, d):
    """The consensus of each greedy cluster, its members aligned with the centroid."""
    from luminode.operators import greedy

    seqs = stored(sequences(documents(spark, d)), "sequences")
    clusters = greedy.greedy_clusters(seqs, "doc_id", "seq", 0.8, keep=False)
    out = greedy.cluster_consensus(seqs, clusters, "doc_id", "seq")
    return out.select("cluster", "members", F.length("consensus").alias("length"), F.md5("consensus").alias("consensus"))
