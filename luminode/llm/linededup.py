"""Lines that repeat across documents: two Bloom filters, exact confirmation of what they suspect.

A first pass marks the hashes of all lines in two filters, seen once and seen twice. A second one
sends only lines that the second filter holds (true repeats and few others) to be counted exactly,
by a 128-bit digest. Everything else stays where it is; at the filters' greatest size more lines
are suspected, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from luminode.llm import bloom
from luminode.llm.common import free_names, stored
from luminode.llm.words import _LOWER, BLANKS, hashed, pieces, raw

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3


@dataclass
class Lines:
    data: np.ndarray  # all bytes of the texts
    lower: np.ndarray  # the same with A-Z in lower case
    first: np.ndarray  # first line of each text, and the number of lines
    start: np.ndarray  # first byte of each line
    stop: np.ndarray  # byte after its last, before the line feed
    key: np.ndarray  # lines that have a key
    key_start: np.ndarray  # first byte of each key
    key_stop: np.ndarray  # byte after it

    def owners(self) -> np.ndarray:
        """The text of each line with a key."""
        return np.searchsorted(self.first, self.key, "right") - 1

    def digests(self, chosen: np.ndarray) -> list[bytes]:
        data = memoryview(self.lower)
        return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.key_start[chosen].tolist(), self.key_stop[chosen].tolist())]


def split_lines(texts: pa.Array, least_chars: int = LEAST_CHARS) -> Lines:
    """Lines of some texts; a key is a line without blanks at its ends, of at least so many code points."""
    data, edges = raw(texts)
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([edges[:-1], feeds + 1]))
    stop = np.sort(np.concatenate([feeds, edges[1:]]))
    first = np.searchsorted(feeds, edges) + np.arange(len(edges))
    solid = np.flatnonzero(~BLANKS[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, stop)
    key = np.flatnonzero(b > a)
    key_start, key_stop = solid[a[key]], solid[b[key] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = chars[key_stop] - chars[key_start] >= least_chars
    return Lines(data, _LOWER[data], first, start, stop, key[long], key_start[long], key_stop[long])


def suspected_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, doc_id): each document's distinct lines that the seen-twice filter holds, by digest.

    Every line that two documents have is among them. Rows without an id take no part.
    """
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in pieces(batch.column(0)):
            lines = split_lines(part, least_chars)
            keys, owner = hashed(lines.lower, lines.key_start, lines.key_stop), lines.owners()
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            yield keys[fresh]  # a line counts once a document

    _, twice = bloom.once_and_twice(rows.select("text"), keys_of, bloom.bits_for(n_lines))
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in pieces(batch.column(1)):
                lines = split_lines(part, least_chars)
                chosen = np.flatnonzero(bloom.holds(shared.value, hashed(lines.lower, lines.key_start, lines.key_stop)))
                ids = batch.column(0).slice(at, len(part)).to_numpy(zero_copy_only=False)[lines.owners()[chosen]]
                found = sorted(set(zip(ids.tolist(), lines.digests(chosen))))
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([d for _, d in found], pa.binary()), pa.array([i for i, _ in found], pa.int64())], ["key", "doc_id"])

    return rows.mapInArrow(suspects, "key binary, doc_id long")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, gone): digests of the lines that each document loses.

    A line found in at least `least_documents` documents stays in the one with the largest id.
    """
    suspects = stored(suspected_lines(docs, doc_id, text, least_chars), "suspects")
    # a distinct count is taken by line and document first: no line's documents meet in one task
    counted = suspects.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_documents)
    # a line of very many documents is split by Spark, as the left side of a left join of two tables may be
    repeats = stored(counted.select("key", "keeper"), "repeats")
    met = suspects.join(repeats, "key", "left").where(F.col("doc_id") != F.col("keeper"))
    return met.groupBy("doc_id").agg(F.collect_set("key").alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with the text without repeated lines, n_lines (before) and n_dropped.

    Lines end at line feeds; a null or empty text is one empty line, and becomes an empty text. A
    line's key has no ASCII blanks at its ends and A-Z in lower case. Lines with a key of at least
    `least_chars` code points that at least `least_documents` ids have are dropped but in the
    largest of these ids, wherever they stand there. Rows that repeat an id count as one document
    and lose or keep a line alike. A row with a null id neither counts nor loses lines. All other
    columns stay; columns named n_lines or n_dropped give way.
    """
    own, gone = free_names(docs.columns, "id", "gone")
    drops = dropped_lines(docs, doc_id, text, least_chars, least_documents).select(F.col("doc_id").alias(own), F.col("gone").alias(gone))
    given = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.join(drops, docs[doc_id].cast("long") == drops[own], "left").select(*[docs[c] for c in given], F.col(gone))
    place = [c.lower() for c in given].index(text.lower())
    fields = [f for f in docs.schema.fields if f.name in given]
    fields[place] = StructField(fields[place].name, StringType())
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, dropped, at = [], [], [], 0
            losses = batch.column(len(given))
            for part in pieces(batch.column(place)):
                lines = split_lines(part, least_chars)
                number = np.diff(lines.first)
                counts.append(number)
                lost = np.zeros(len(number), np.int64)
                data, owner = lines.data.tobytes(), lines.owners()
                bounds = np.searchsorted(owner, np.arange(len(number) + 1))
                for k in range(len(number)):
                    first, last = lines.first[k], lines.first[k + 1]
                    whole = data[lines.start[first] : lines.stop[last - 1]]
                    away = losses[at + k].as_py()
                    if away:
                        away, mine = set(away), np.arange(bounds[k], bounds[k + 1])
                        gone = {n for n, d in zip(lines.key[mine].tolist(), lines.digests(mine)) if d in away}
                        whole = b"\n".join(data[lines.start[n] : lines.stop[n]] for n in range(first, last) if n not in gone)
                        lost[k] = len(gone)
                    kept.append(whole)
                dropped.append(lost)
                at += len(part)
            columns = [c for k, c in enumerate(batch.columns[: len(given)])]
            columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
            number = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, number(counts), number(dropped)], schema.names)

    return rows.mapInArrow(cut, schema)


def oracle_sql() -> str:
    """The rows of op13 for SQL engines that split strings."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH l AS (SELECT doc_id, k, lines[k] AS line, translate(trim(lines[k], {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
r AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN r USING (key) GROUP BY doc_id"""
