"""Words of whole Arrow batches as 64-bit keys, in numpy.

A text is cut at separator bytes; A-Z count as a-z. A word's key is a polynomial of its bytes
modulo 2**64, taken from running sums over a block of text, and scrambled. Words are told apart by
their keys only: two of a billion distinct words share one with a probability of some 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from luminode.operators.similar import mix

#: Bytes of text handled at once (one longer text is taken alone), and hashed at once.
PIECE_BYTES, BLOCK_BYTES = 4_000_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 5
_ODD = np.uint64(0xD6E8FEB86659FD93)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Separators: the ASCII blanks, or every ASCII sign that is no digit or letter.
BLANKS = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
SIGNS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


class _Powers:
    """Powers of a base, and of its inverse, modulo 2**64; as many as were ever asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            for x in (cls.up, cls.down):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        return cls.up[:n], cls.down[:n]


def hashed(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Keys of the stretches start..stop (ascending, apart) of an array of bytes."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        a = start[k]
        j = max(k + 1, int(np.searchsorted(start, a + BLOCK_BYTES)))
        b = stop[j - 1]
        up, down = _Powers.upto(int(b - a))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[symbols[a:b]] * up, out=sums[1:])
        low, high = start[k:j] - a, stop[k:j] - a
        out[k:j] = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64) * _ODD)
        k = j
    return out


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """The texts of a batch, some at a time, about `size` bytes each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, edges = raw(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + size, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after another, and where each begins (and the last ends); null is empty."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.empty(0, np.uint8)
    return data, edges - edges[0]


@dataclass
class Words:
    data: np.ndarray  # the texts' bytes, A-Z in lower case
    start: np.ndarray  # first byte of each word
    stop: np.ndarray  # byte after it
    first: np.ndarray  # first word of each text, and the number of words

    def keys(self) -> np.ndarray:
        return hashed(self.data, self.start, self.stop)


def split(texts: pa.Array, separators: np.ndarray = BLANKS) -> Words:
    data, edges = raw(texts)
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = edges[edges < len(data)]
    begins[heads] = inside[heads]
    tails = edges[edges > 0] - 1
    ends[tails] = inside[tails]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(_LOWER[data], start, stop, np.searchsorted(start, edges))


class Lookup:
    """Number of each of some distinct keys; -1 for others. Open addressing, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.held, self.number = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, probe = np.arange(len(keys)), np.uint64(0)
        while len(left):
            slot = (keys[left] + probe) & self.mask
            free = np.flatnonzero(self.number[slot] < 0)
            taken, at = np.unique(slot[free], return_index=True)
            placed = free[at]
            self.held[taken], self.number[taken] = keys[left[placed]], left[placed]
            left = np.delete(left, placed)
            probe += np.uint64(1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left, probe = np.full(len(keys), -1, np.int32), np.arange(len(keys)), np.uint64(0)
        while len(left):
            own = keys[left] if probe else keys
            slot = (own + probe) & self.mask
            number = self.number[slot]
            hit = (self.held[slot] == own) & (number >= 0)
            out[left[hit]] = number[hit]
            left = left[~hit & (number >= 0)]
            probe += np.uint64(1)
        return out
