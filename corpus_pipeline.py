"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns
of documents. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luminode.llm import decontam, neardup, packing, quality, secrets
from luminode.llm.common import free_names, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below one half)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "score")
    return quality.score_quality(docs, model, into=score).where(F.col(score) >= 0.5).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicate(docs, width=5, similarity=80).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more of the words repeat benchmark passages."""
    prefix = free_names(docs.columns, *decontam.ADDED)[0].removesuffix(decontam.ADDED[0])
    judged = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=True, prefix=prefix)
    return judged.where(~decontam.contaminated(f"{prefix}n_words", f"{prefix}n_hit")).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; n_chars follows the text."""
    (spans,) = free_names(docs.columns, "secrets")
    masked = secrets.redact(secrets.scan_secrets(docs, into=spans), spans=spans)
    changed = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return masked.withColumn("n_chars", changed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of the permitted lengths; a row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret masking", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor best-fit packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
