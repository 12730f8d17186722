"""What the operators of this subpackage share: shared-folder tables, bounded broadcasts, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luminode.sources.shared import new_path, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0 (used for learning)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns; input columns whose names clash (in any case) give way."""
    names = {c.lower() for c in columns}
    return df.select(*[df[c] for c in df.columns if c.lower() not in names], *[c.alias(n) for n, c in columns.items()])


def free_names(taken: list[str], *names: str) -> list[str]:
    """Names for columns that clash with none of the taken ones, in any case."""
    lower, sign = {t.lower() for t in taken}, "__"
    while any((sign + n).lower() in lower for n in names):
        sign += "_"
    return [sign + n for n in names]
