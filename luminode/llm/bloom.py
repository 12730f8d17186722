"""Bloom filters of 64-bit keys: marked by all tasks, merged segment by segment, bounded in size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from luminode.operators.similar import mix

#: Bits of a segment, which is merged by one task; the most bits of a filter (32 MB); places marked by a key.
SEGMENT_BITS, MOST_BITS, PLACES = 1 << 19, 1 << 28, 3
#: Bits for each key that is expected; at MOST_BITS a filter takes more keys and tells less, but never misses one.
BITS_A_KEY = 12


def bits_for(keys: int) -> int:
    return min(MOST_BITS, max(SEGMENT_BITS, 1 << (BITS_A_KEY * max(keys, 1) - 1).bit_length()))


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = mix(keys) | np.uint64(1)
    for k in range(PLACES):
        yield (mix(keys + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def mark(bloom: np.ndarray, keys: np.ndarray) -> None:
    for at in _places(keys, 8 * len(bloom)):
        np.bitwise_or.at(bloom, at >> 3, (1 << (at & 7)).astype(np.uint8))


def holds(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have been marked; always true of those that were."""
    out = np.ones(len(keys), bool)
    for at in _places(keys, 8 * len(bloom)):
        out &= (bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def once_and_twice(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filters over all rows: keys seen, and keys seen more than once.

    keys_of gives arrays of keys of a batch. A task marks a pair of filters of its own; pairs are
    merged by segments, (once | once', twice | twice' | once & once'), so a key that two tasks saw
    counts as seen twice. Either filter has `bits` bits (at most MOST_BITS), and so has what comes
    to the driver.
    """
    schema = "segment int, once binary, twice binary"
    names = ["segment", "once", "twice"]

    def record(rows):
        number, once, twice = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for keys in keys_of(batch):
                own, times = np.unique(keys, return_counts=True)
                mark(twice, own[(times > 1) | holds(once, own)])
                mark(once, own)
        size = SEGMENT_BITS // 8
        for k in range(bits // SEGMENT_BITS):
            part = once[k * size : (k + 1) * size]
            if part.any():
                yield record([(k, part.tobytes(), twice[k * size : (k + 1) * size].tobytes())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if k != at:
                    if at is not None:
                        yield record([(at, once.tobytes(), twice.tobytes())])
                    at, once, twice = k, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if at is not None:
            yield record([(at, once.tobytes(), twice.tobytes())])

    parts = rows.mapInArrow(marked, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(merged, schema)
    out, size = (np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)), SEGMENT_BITS // 8
    found = parts.toArrow()
    for n, segment in enumerate(found.column("segment").to_pylist()):
        for k, name in enumerate(names[1:]):
            out[k][segment * size : (segment + 1) * size] = np.frombuffer(found.column(name)[n].as_buffer(), np.uint8)
    return out
