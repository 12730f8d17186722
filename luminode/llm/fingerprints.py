"""Document fingerprints by locally consistent parsing.

Level by level a text is cut into phrases: runs of a symbol become one symbol, deterministic coin
tossing turns each symbol into a small label that depends on it and a few symbols before it, and a
phrase starts at every local maximum of the labels. The hash of a phrase is its name, a symbol of
the next level. Equal substrings are cut alike away from their ends, wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.llm.neardup import mix

LEVELS = 5
#: Names of phrases from this level on (about 27 characters) enter the fingerprint.
FIRST_LEVEL = 3
SKETCH = 64
#: Code points parsed together; bounds the arrays alive in a task (one longer text is parsed alone).
CHUNK_CHARS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _coin(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which a label differs from the one before) + that bit of it."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[starts] = ~labels[starts]
    differ = labels ^ before
    lowest = differ & (~differ + differ.dtype.type(1))
    place = np.bitwise_count(lowest - lowest.dtype.type(1))
    return (2 * place + ((labels & lowest) != 0)).astype(np.uint8)


def _names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the phrases that begin at starts: hashes of their symbols in order."""
    sizes = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(mix(symbols + _ODD * place.astype(np.uint64)), starts) + sizes.astype(np.uint64))


def parse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names, offsets) of the phrases of the texts that start at offsets (all non-empty)."""
    fresh = np.empty(len(symbols), bool)
    fresh[1:] = symbols[1:] != symbols[:-1]
    fresh[offsets] = True
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    symbols = np.where(runs > 1, mix(symbols[at] + _ODD * runs), symbols[at])
    offsets = np.searchsorted(at, offsets)
    labels = _coin(_coin(_coin(symbols, offsets), offsets), offsets)
    higher = np.empty(len(labels), bool)
    higher[1:] = labels[1:] > labels[:-1]
    higher[0] = True
    peak = higher.copy()
    peak[:-1] &= ~higher[1:]
    peak[offsets] = True
    starts = np.flatnonzero(peak)
    return _names(symbols, starts), np.searchsorted(starts, offsets)


def sketches(texts: list[str], levels: int = LEVELS, first: int = FIRST_LEVEL, size: int = SKETCH) -> list[np.ndarray]:
    """The `size` smallest 32-bit marks among each text's phrase names of levels first..levels, ascending."""
    out = [np.empty(0, np.uint32) for _ in texts]
    used = [k for k, t in enumerate(texts) if t]
    if not used:
        return out
    symbols = np.frombuffer("".join(texts[k] for k in used).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in used])[:-1]])
    found, owners = [], []
    for level in range(1, levels + 1):
        symbols, offsets = parse(symbols, offsets)
        if level >= first:
            found.append(mix(symbols + np.uint64(level)) >> np.uint64(32))
            owners.append(np.repeat(np.arange(len(used), dtype=np.uint64), np.diff(np.append(offsets, len(symbols)))))
    marks = np.unique((np.concatenate(owners) << np.uint64(32)) | np.concatenate(found))
    edges = np.searchsorted(marks, np.arange(len(used) + 1, dtype=np.uint64) << np.uint64(32))
    for k, low, high in zip(used, edges[:-1], edges[1:]):
        out[k] = (marks[low : min(high, low + size)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard likeness of two phrase sets from their smallest marks; 1 for two empty ones."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    return float((np.isin(union, a) & np.isin(union, b)).sum()) / len(union)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds `into`: the fingerprint of the whole text, 8 hex digits per mark; empty for null or empty texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held, n = [], [], 0
            for value in batch:
                held.append(value.as_py() or "")
                n += len(held[-1])
                if n > CHUNK_CHARS:
                    out += map(written, sketches(held))
                    held, n = [], 0
            yield pa.array([*out, *map(written, sketches(held))], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(into, F.arrow_udf(run, "string")(F.col(text)))


def with_neighbours(docs: DataFrame, ranges: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (piece, tail, doc_id, text) laid out so that every document's successor follows it.

    Ids are cut into ranges by approximate quantiles. Each range, a piece, is followed by a copy of
    the next range's first document (tail), the last by the first of all: one row per range, so
    whole texts move once and no window over all ids is needed. Null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    points = [k / ranges for k in range(1, ranges)]
    cuts = rows.select(F.percentile_approx("doc_id", points, 10_000)).first()[0] if points else []
    edges = np.array(sorted(set(cuts or [])), np.int64)

    def locate(ids: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        low = np.iinfo(np.int64).min
        return pa.array(np.searchsorted(edges, pc.fill_null(ids, low).to_numpy(zero_copy_only=False), "right"), pa.int32())

    locate.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    placed = rows.withColumn("piece", F.arrow_udf(locate, "int")(F.col("doc_id")))
    # one row per range reaches the driver
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    firsts = sorted(placed.groupBy("piece").agg(F.min(key).alias("first")).collect())
    if not firsts:
        return placed.select("piece", F.lit(0).alias("tail"), "doc_id", "text")
    before = [(r.piece, r.first.doc_id, firsts[k - 1].piece) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "head_piece int, head_id long, piece int")
    first_rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")))
    # rows that repeat the first id: the smallest text
    first_rows = first_rows.groupBy("head_piece", "piece").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    tails = first_rows.select("piece", F.lit(1).alias("tail"), "r.doc_id", "r.text")
    return placed.select("piece", F.lit(0).alias("tail"), "doc_id", "text").union(tails)


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness.

    A document's edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document in ascending order of id, then text (null ids first); after the last
    comes the first. Null and empty texts have an empty fingerprint; two empty ones have likeness 1.
    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ranges = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_neighbours(docs, ranges, doc_id, text).repartition("piece").sortWithinPartitions("piece", "tail", F.col("doc_id").asc_nulls_first(), "text")
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def finish(chain: list[tuple]) -> pa.RecordBatch:
        """Rows of one piece in order; all but the last have their successor here."""
        texts = [t for _, t in chain]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
        marks = sketches(texts + edited)
        own, changed = marks[: len(texts)], marks[len(texts) :]
        columns = [
            [i for i, _ in chain[:-1]],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            [written(m) for m in own[:-1]],
            [written(m) for m in changed],
            [likeness(a, b) for a, b in zip(own, changed)],
            [likeness(a, b) for a, b in zip(own, own[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, chain, n = None, [], 0
        for batch in batches:
            for p, i, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if p != piece:
                    if len(chain) > 1:
                        yield finish(chain)
                    piece, chain, n = p, [], 0
                chain.append((i, value.as_py()))
                n += len(chain[-1][1])
                if n > CHUNK_CHARS and len(chain) > 1:
                    yield finish(chain)
                    chain = chain[-1:]
                    n = len(chain[0][1])
        if len(chain) > 1:
            yield finish(chain)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
