"""Registry of queries, and the stand-in inputs that they derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where they lie in fewer parts: mapping texts to letters costs far more than that."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def rnd(c, places: int = 6):
    """A rounded double without negative zero, as the SQL side writes it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places) + F.lit(0.0)


def rnd_scaled(c, places: int):
    """A double rounded as the SQL side rounds: scaled, to the nearest whole number (halves away from zero), scaled back.

    Spark's own rounding goes by a double's shortest decimal digits; the two differ where scaling lands on a half.
    """
    return F.round(c * F.lit(10.0**places)) / F.lit(10.0**places)


LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def dna(c):
    """A stand-in sequence: the letters a-z of a text, mapped to bases in turn."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), LETTERS, BASES)


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, seq: dna(text) of whole tables, worked out on the bytes of half a megabyte of text at a time."""
    table = np.zeros(256, np.uint8)
    for letters in (LETTERS, LETTERS.upper()):
        table[list(letters.encode())] = list(BASES.encode())

    def mapped(texts: pa.LargeStringArray) -> pa.Array:
        for odd, letter in (("\u212a", "k"), ("\u0130", "i")):  # all that lower case makes a-z of beside A-Z
            texts = pc.replace_substring(texts, odd, letter)
        plain = pc.fill_null(texts, "")
        at = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = plain.buffers()[2]
        letters = table[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data else np.empty(0, np.uint8)
        kept = letters != 0
        places = np.append(np.int64(0), np.cumsum(kept, dtype=np.int64))[at - at[0]].astype(np.int32)
        out = pa.StringArray.from_buffers(len(plain), pa.py_buffer(places), pa.py_buffer(letters[kept]))
        return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.string())) if texts.null_count else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + 500_000)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), mapped(texts.slice(start, stop - start))], ["doc_id", "seq"])
                start = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, seq string")


def dna_sql(c: str) -> str:
    return f"translate(regexp_replace(lower({c}), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, image_id, label and a non-negative 64-channel spectrum v."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("image_id"), "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))


SPECTRA = "(SELECT vec_id, vec_id % 5 AS image_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, cell, code (class), x and y in -500..500 of stand-in cells."""
    at = lambda k: F.col("embedding")[k].cast("double") * 1000
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("image_id"), F.col("vec_id").alias("cell"), F.col("label").alias("code"), at(0).alias("x"), at(1).alias("y"))


CELLS = "(SELECT vec_id % 4 AS image_id, vec_id AS cell, label AS code, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, label (region), v: every event is a pixel of one of three images, 41 wide and as high as the table needs.

    Each stripe of eight rows has labels of its own, so regions grow in number with the table.
    """
    k = F.col("event_id")
    y = F.floor(k / 123).cast("int")
    label = (F.col("user_id") % 12 + 1 + 12 * F.floor(y / 8)).cast("int")
    place = table(spark, sf_dir, "events").select((k % 3).alias("image_id"), (F.floor(k / 3) % 41).cast("int").alias("x"), y.alias("y"), label.alias("label"), "event_id", "value")
    return place.groupBy("image_id", "x", "y").agg(F.min_by("label", "event_id").alias("label"), F.min_by("value", "event_id").alias("v"))


PIXELS = """(SELECT event_id % 3 AS image_id, ((event_id // 3) % 41)::INT AS x, (event_id // 123)::INT AS y,
  arg_min((user_id % 12 + 1 + 12 * (event_id // 984))::INT, event_id) AS label, arg_min(value, event_id) AS v FROM events GROUP BY ALL)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in alignment hits: probes are parts, molecules orders, taxa suppliers modulo 7."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("probe_id"),
        F.col("l_orderkey").alias("molecule_id"),
        (F.col("l_suppkey") % 7).alias("taxon"),
        F.col("l_quantity").cast("int").alias("mch"),
        (F.col("l_quantity") % 25 + F.col("l_linenumber")).cast("int").alias("length"),
        (F.col("l_discount") * 1000).alias("qcovhsp"),
        (F.col("l_tax") * 100).alias("evalue"),
        (F.col("l_extendedprice") / 1000).alias("bitscore"),
        (F.col("l_returnflag") == "A").alias("target_hit"),
        (F.col("l_linestatus") == "F").alias("full_hit"),
        "l_linenumber",
        "l_suppkey",
    )


HITS = """(SELECT l_partkey AS probe_id, l_orderkey AS molecule_id, l_suppkey % 7 AS taxon, l_quantity::INT AS mch,
  (l_quantity % 25 + l_linenumber)::INT AS length, l_discount * 1000 AS qcovhsp, l_tax * 100 AS evalue, l_extendedprice / 1000 AS bitscore,
  l_returnflag = 'A' AS target_hit, l_linestatus = 'F' AS full_hit, l_linenumber, l_suppkey FROM lineitem)"""
