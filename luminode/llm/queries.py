"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luminode.llm import centroids, collocations, decontam, fingerprints, licenses, linededup, maxent, neardup, packing, quality, secrets, tokens, warc
from luminode.llm.common import fold, stored, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.span_list("secrets", secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.span_list("secrets", secrets.KINDS).alias("spans"),
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[3:]],
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")), into="score")
    return scored.select("doc_id", (fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), maxent.learning())
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.prefix_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    prefixes = stored(docs.select("doc_id", n_bytes.alias("n_bytes"), "prefixes"), "prefixes")
    counted = prefixes.select("doc_id", "n_bytes", tokens.tokens_in(F.col("prefixes")).alias("n_tokens"), tokens.prefix_within(F.col("prefixes"), tokens.LIMIT).alias("chars_in_limit"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit"), "chars_in_limit")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang")).drop("n_left", "n_right")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_quality,
        op3_fingerprints,
        op4_decontamination,
        op5_language_model,
        op6_packing,
        op7_near_duplicates,
        op8_warc,
        op9_licenses,
        op10_token_counts,
        op11_collocations,
        op12_centroids,
        op13_line_dedup,
    )
}
ORACLE_SQL = {
    "op9_licenses": licenses.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
    "op12_centroids": centroids.oracle_sql(),
    "op13_line_dedup": linededup.oracle_sql(),
}
