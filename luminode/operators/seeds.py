"""Places of long sequences that hold a wanted k-mer, found in one pass over their letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from luminode.operators.similar import mix

#: Letters hashed at a time; bits of the largest mark table, and of a bitmap of Spark's bitmap functions.
STRETCH, MOST_BITS, BITMAP_BITS = 1 << 20, 28, 15
_ODD = 0x9E3779B97F4A7C15


def hashes(letters: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k letters."""
    power, size, out, done = letters.astype(np.uint64) + np.uint64(1), 1, np.zeros(len(letters) + 1, np.uint64), 0
    while size <= k:
        factor = np.uint64(pow(_ODD, size, 2**64))
        if k & size:
            out = out[: len(letters) - done - size + 1] * factor + power[done : len(letters) - size + 1]
            done += size
        if 2 * size <= k:
            power = power[:-size] * factor + power[size:]
        size *= 2
    return mix(out)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of some texts, and where each one ends: bytes, or code points where a letter is not ASCII."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    if len(letters) and letters.max() > 127:
        plain = texts.to_pylist()
        return np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32), np.cumsum([len(t) for t in plain])
    return letters, ends[1:] - ends[0]


def _cut(letters: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The texts between places of the letters."""
    size = stop - start
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    if letters.dtype == np.uint8:
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(letters[at])).cast(pa.string())
    whole = letters[at].tobytes().decode("utf-32-le")
    return pa.array([whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


def places(df: DataFrame, k: int, marks=None, bits: int = 0, reach: int = 0) -> DataFrame:
    """(the columns before the last, at, seed, n, first, around) for every run of k letters of the last column.

    seed is the run's hash, n the sequence's length; around is what lies up to `reach` letters
    before and behind the run, from place `first`. With marks (see `marked`) only runs that may be wanted.
    """
    kinds = [to_arrow_type(f.dataType) for f in df.schema[:-1]]
    names = [*df.columns[:-1], "at", "seed", "n", "first", "around"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, np.uint8) if marks else None
        for batch in batches:
            stretch = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)) // STRETCH
            edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), batch.num_rows]
            for some in (batch.slice(a, b - a) for a, b in zip(edges, edges[1:])):
                letters, ends = _flat(some.column(some.num_columns - 1))
                for low in range(0, len(letters) - k + 1, STRETCH):
                    seed = hashes(letters[low : low + STRETCH + k - 1], k)
                    at = np.arange(len(seed))
                    if table is not None:
                        bit = (seed >> np.uint64(64 - bits)).astype(np.int64)
                        at = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    seed, at = seed[at], at + low
                    owner = np.searchsorted(ends, at, "right")
                    inside = at + k <= ends[owner]
                    seed, at, owner = seed[inside], at[inside], owner[inside]
                    begin, end = np.concatenate([[0], ends])[owner], ends[owner]
                    start = np.maximum(at - reach, begin)
                    columns = [some.column(c).take(pa.array(owner)).cast(t) for c, t in enumerate(kinds)]
                    numbers = [pa.array((x).astype(np.int32)) for x in (end - begin, start - begin)]
                    around = _cut(letters, start, np.minimum(at + k + reach, end))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((at - begin).astype(np.int32)), pa.array(seed.view(np.int64)), *numbers, around], names)

    given = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema[:-1])
    return df.mapInArrow(find, given + "at int, seed long, n int, first int, around string")


def marked(seeds: DataFrame) -> tuple:
    """A broadcast table of bits, set where the top bits of a wanted hash say, and the number of those bits.

    It has 64 bits a hash, but at most 2^28 (32 MB): beyond that more runs pass wrongly, and none is missed.
    """
    session, n = seeds.sparkSession, seeds.select("seed").distinct().count()
    bits = min(max(BITMAP_BITS, int(64 * n).bit_length()), MOST_BITS)
    bit = F.shiftrightunsigned("seed", 64 - bits)
    high, low = F.shiftrightunsigned(bit, BITMAP_BITS), bit.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    maps = seeds.groupBy(high.alias("part")).agg(F.bitmap_construct_agg(low).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for row in maps.toLocalIterator():
        size = 1 << (BITMAP_BITS - 3)
        out[row.part * size : (row.part + 1) * size] = row.bits
    return session.sparkContext.broadcast(bytes(out)), bits


def runs_of(q: pa.Array, s: pa.Array) -> pa.Array:
    (left, ends), (right, other) = _flat(q), _flat(s)
    if not np.array_equal(ends, other):
        raise ValueError("aligned sequences differ in length")
    starts = np.concatenate([[0], ends])[:-1]
    differ = np.flatnonzero(left != right)
    owner = np.searchsorted(ends, differ, "right")
    first = np.ones(len(differ), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.where(first, starts[owner] - 1, np.concatenate([[-1], differ[:-1]]) if len(differ) else differ)
    last = starts - 1
    last[owner] = differ  # the last mismatch of a row is written last
    run = ends - 1 - last
    mch = run.copy()
    np.maximum.at(run, owner, differ - before - 1)
    np.maximum.at(mch, owner, differ - before - first)
    return pa.StructArray.from_arrays([pa.array(mch.astype(np.int32)), pa.array(run.astype(np.int32))], ["mch", "run"])


runs_of.__annotations__ = {"q": pa.Array, "s": pa.Array, "return": pa.Array}


def aligned_runs(q, s):
    """Struct of mch and run: max_homology and longest_run of two texts of equal length, whole batches at a time."""
    return F.arrow_udf(runs_of, "struct<mch:int,run:int>")(q, s)
