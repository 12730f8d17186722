"""Readers and writers of the file formats of a probe design and an imaging run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the design table, in file order.
DESIGN = (
    "design_id STRING, sample STRING, target_rank STRING, similarity DOUBLE, max_continuous_homology INT, min_tm DOUBLE, max_tm DOUBLE, gc DOUBLE, "
    "include_start INT, include_end INT, probe_selection_method STRING, primerset STRING, otu STRING, tpn INT, freqll DOUBLE, bot DOUBLE, "
    "bitscore_thresh DOUBLE, barcodeselection STRING, bplc INT, helper_probe_repeat INT, sod DOUBLE, dnaconc DOUBLE, mt_cutoff DOUBLE, ot_gc_cutoff INT, themecolor STRING"
)
# Columns of the alignment-hit tables, in file order.
HITS = {
    "molecule": "molecule_id STRING, reference_id STRING, pid DOUBLE, qcovhsp DOUBLE, length INT, mismatch INT, gapopen INT, qstart INT, qend INT, sstart INT, send INT, evalue DOUBLE, bitscore DOUBLE, staxids STRING",
    "probe": "probe_id STRING, molecule_id STRING, pid DOUBLE, qcovhsp DOUBLE, length INT, mismatch INT, gapopen INT, probe_start INT, probe_end INT, molecule_start INT, molecule_end INT, evalue DOUBLE, bitscore DOUBLE, staxids STRING, qseq STRING, sseq STRING",
    "probe_slim": "probe_id STRING, molecule_id STRING, pid DOUBLE, qcovhsp DOUBLE, length INT, mismatch INT, gapopen INT, probe_start INT, probe_end INT, molecule_start INT, molecule_end INT, evalue DOUBLE, bitscore DOUBLE, qseq STRING, sseq STRING",
}
CLUSTERS = "rec_type STRING, cluster_num INT, seq_length INT, pid DOUBLE, strand STRING, u1 STRING, u2 STRING, comp_alignment STRING, query_label STRING, target_label STRING"
CANDIDATE = ("probe_id INT", "seq STRING", "p_start INT", "ln INT", "n INT", "gc DOUBLE", "tm DOUBLE", "self_any DOUBLE", "self_end DOUBLE", "hairpin DOUBLE", "quality DOUBLE")
IMAGES = "sample STRING, images STRING, treatment STRING, sampling_time STRING, sampling_day_reference INT, design_id STRING, probedesign STRING, spc INT, zslice INT, marker_x INT, marker_y INT"
PIXELS = "image_id LONG, x INT, y INT, label INT, intensity ARRAY<DOUBLE>"
TAXONOMY = "taxid STRING, parent STRING, rank STRING, name STRING"


def read_designs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DESIGN).option("header", True).csv(path)


def design_parameters(designs: DataFrame, design_id: str) -> DataFrame:
    return designs.where(F.col("design_id") == design_id)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """molecule_id (first word of the title) and sequence; records may span lines."""
    # a record begins at a line that starts with >; titles may hold the sign too
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n", 2)
    return records.select(F.element_at(F.split(F.element_at(parts, 1), r"\s"), 1).alias("molecule_id"), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, id: str = "molecule_id", seq: str = "seq", by: tuple[str, ...] = (), distinct: bool = False) -> None:
    """One record per row (or distinct sequence), one folder per value of `by`."""
    rows = df.dropDuplicates([*by, seq]) if distinct else df
    writer = rows.select(*by, F.concat(F.lit(">"), F.col(id), F.lit("\n"), F.col(seq)).alias("value")).write
    (writer.partitionBy(*by) if by else writer).text(path)


def read_hits(spark: SparkSession, path: str, kind: str = "probe") -> DataFrame:
    """Tab-separated alignment hits of 14, 16 or 15 columns; an empty file has no rows."""
    return spark.read.schema(HITS[kind]).option("sep", "\t").csv(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster table: seed (S) and member (H) records."""
    return spark.read.schema(CLUSTERS).option("sep", "\t").csv(path).where(F.col("rec_type").isin("S", "H"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated candidate probes; head lines, which do not start with a number, go."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^[0-9]+\s"))
    return rows.select(*[F.element_at(fields, k).cast(kind.split(" ")[1].lower()).alias(kind.split(" ")[0]) for k, kind in enumerate(CANDIDATE, 1)])


def read_keyed(spark: SparkSession, path: str, pattern: str, schema: str, key: str = "key") -> DataFrame:
    """Many CSV files with a key from each file's path (first group of pattern)."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).csv(path).withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def write_partitioned(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """One folder per key; readers that filter on a key read its folder only.

    Rows are dealt by ranges of key and `order` (by default a hash of the row), so that a key with
    very many rows is written by many tasks, as many files of its folder.
    """
    within = [F.col(c) for c in order] if order else [F.xxhash64(*df.columns)]
    df.repartitionByRange(*keys, *within).write.partitionBy(*keys).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """A table of the session's catalog in buckets by key, sorted: joins and groupings on the key need no exchange.

    Two tables with as many buckets are joined bucket by bucket. path is a folder that all executors share.
    """
    dealt = df.repartition(buckets, *keys)  # each bucket is one file
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_pool(path: str, *parts: DataFrame, seq: str = "seq") -> None:
    """The oligos of several pools, one per line."""
    pool = parts[0].select(seq)
    for p in parts[1:]:
        pool = pool.unionByName(p.select(seq))
    pool.write.text(path)


def order_form(df: DataFrame, name: str, seq: str, amount: Column, purification: Column) -> DataFrame:
    """Order lines, the shortest first."""
    lines = df.select(F.col(name).alias("name"), F.col(seq).alias("sequence"), amount.alias("amount"), purification.alias("purification"), F.length(seq).alias("length"))
    return lines.orderBy("length", "name")


def write_order_form(df: DataFrame, path: str, name: str, seq: str, amount: Column, purification: Column) -> None:
    order_form(df, name, seq, amount, purification).write.option("header", True).csv(path)


def write_matrix(long: DataFrame, path: str, row: str, column: str, value: str, columns: list) -> None:
    """A wide matrix as CSV with the row's name first."""
    to_matrix(long, row, column, value, columns).write.option("header", True).csv(path)


def read_spectra(spark: SparkSession, path: str, channels: int, keys: str = "") -> DataFrame:
    """A wide CSV of key columns and channels, as an array."""
    first = [f.strip() for f in keys.split(",") if f.strip()]
    schema = ", ".join([*first, *[f"c{k} DOUBLE" for k in range(channels)]])
    return spark.read.schema(schema).csv(path).select(*[f.split(" ")[0] for f in first], F.array(*[f"c{k}" for k in range(channels)]).alias("v"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMAGES).option("header", True).csv(path)


def read_pixels(spark: SparkSession, path: str, image_id: int | None = None) -> DataFrame:
    """The pixel table, stored by image; one image reads its folder only."""
    px = spark.read.schema(PIXELS).parquet(path)
    return px if image_id is None else px.where(F.col("image_id") == image_id)


def to_matrix(long: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A wide matrix with a stated list of columns, zeros filled; for sinks."""
    return long.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)


def pending(images: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return images.join(done.select(key).distinct(), key, "left_anti")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAXONOMY).parquet(path)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
