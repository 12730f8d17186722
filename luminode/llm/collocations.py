"""Phrase collocations: an FM-index over word numbers per shard, phrases by two-way interval extension.

A shard is some 700,000 words of one language. Its index is the Burrows-Wheeler transform of the
word numbers, forwards and backwards, sorted by as many words as a phrase may have (enough for
intervals of phrases that long). A phrase is an interval in both; adding a word to the left reads
the forward transform, adding one to the right the backward one, and either keeps the other
interval in step. All phrases of one length are extended at once, in numpy. Counts are summed over
shards; before a length is enumerated, filters of the frequent shorter phrases prune it, and
whatever passes them wrongly is counted exactly and falls out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from luminode.llm import bloom
from luminode.llm.common import stored
from luminode.llm.words import hashed, pieces, split
from luminode.operators.similar import mix

SHARD_WORDS = 700_000
MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Signs that end a piece; blanks between words.
ENDS = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
GAPS = ENDS | np.array([b in (9, 32) for b in range(256)])
#: Parts of a language's candidates that are ranked apart before the last ranking.
PARTS = 64
CHUNK = 100_000
#: Bytes of text that are split into words at once.
ADD_BYTES = 1_000_000
#: Rows of a transform that are extended at once.
SLICE_ROWS = 100_000
_A = np.uint64(0x9E3779B97F4A7C15)

INDEX = "lang string, n_words long, words array<string>, forward binary, backward binary"


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their places, equal keys in order of place; key and place share a word where they fit."""
    bits = max(len(key) - 1, 1).bit_length()
    if int(key.max(initial=0)).bit_length() + bits <= 63:
        both = np.sort((key.astype(np.int64) << bits) | np.arange(len(key)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key, kind="stable")
    return key[order], order


def _transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The number before each suffix, suffixes in order of their first `depth` numbers."""
    bits = int(text.max(initial=1)).bit_length()
    ahead = np.concatenate([text, np.zeros(depth, text.dtype)])
    if bits * depth <= 63:
        key = np.zeros(len(text), np.int64)
        for k in range(depth):
            key <<= bits
            key |= ahead[k : k + len(text)]
        order = np.argsort(key)  # suffixes that agree in all of these words may stand in any order
    else:
        order = np.lexsort([ahead[k : k + len(text)] for k in reversed(range(depth))])
    order -= 1
    return text[order]


class _Shard:
    """Words of one language as they come, until they are indexed."""

    def __init__(self):
        self.n, self.keys, self.breaks, self.known, self.words = 0, [], [], [], []

    def add(self, texts: pa.Array) -> None:
        for part in pieces(texts):
            words = split(part, GAPS)
            if not len(words.start):
                continue
            keys = words.keys()
            ends = np.concatenate([[0], np.cumsum(ENDS[words.data])])
            fresh = np.ones(len(keys), bool)
            fresh[1:] = ends[words.start[1:]] > ends[words.stop[:-1]]
            fresh[words.first[:-1][words.first[:-1] < len(keys)]] = True
            known, at = np.unique(keys, return_index=True)
            data = words.data.tobytes()
            self.n += len(keys)
            self.keys.append(keys)
            self.breaks.append(fresh)
            self.known.append(known)
            self.words.append(pa.array([data[a:b] for a, b in zip(words.start[at].tolist(), words.stop[at].tolist())], pa.binary()).cast(pa.string()))

    def index(self, lang: str, depth: int) -> pa.RecordBatch:
        known, at = np.unique(np.concatenate(self.known), return_index=True)
        number = np.concatenate([np.searchsorted(known, keys).astype(np.int32) + 1 for keys in self.keys])
        fresh = np.concatenate(self.breaks)
        self.keys, self.known, self.breaks = [], [], []
        # a 0 before every piece and at the end
        text = np.zeros(len(number) + int(fresh.sum()) + 1, np.int32)
        text[np.arange(len(number)) + np.cumsum(fresh)] = number
        names = pa.concat_arrays(self.words).take(pa.array(at))
        blocks = [np.ascontiguousarray(_transform(t, depth), np.int32).tobytes() for t in (text, text[::-1])]
        offsets = pa.array([0, len(names)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([self.n], pa.int64()), pa.ListArray.from_arrays(offsets, names), pa.array(blocks[:1], pa.binary()), pa.array(blocks[1:], pa.binary())],
            ["lang", "n_words", "words", "forward", "backward"],
        )


def build_index(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = MAX_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per shard: lang, n_words, its distinct words, and both transforms (32-bit word numbers, 0 between pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, _Shard] = {}
        held = 0
        for batch in batches:
            langs, at = batch.column(0).dictionary_encode(), 0
            codes, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            for part in pieces(batch.column(1), ADD_BYTES):
                own = codes[at : at + len(part)]
                at += len(part)
                for k in np.unique(own):
                    name = names[k]
                    shard = shards.setdefault(name, _Shard())
                    before = shard.n
                    shard.add(part.take(pa.array(np.flatnonzero(own == k))))
                    held += shard.n - before
                    if shard.n >= shard_words:
                        held -= shard.n
                        yield shards.pop(name).index(name, depth)
            # many languages at once: the words held are bounded over all of them
            while held >= 2 * shard_words:
                name = max(shards, key=lambda x: shards[x].n)
                held -= shards[name].n
                yield shards.pop(name).index(name, depth)
        for name, shard in shards.items():
            if shard.n:
                yield shard.index(name, depth)

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, INDEX)


@dataclass
class Intervals:
    """Phrases of one length: their words, and their rows in the forward and backward transform."""

    words: list[np.ndarray]
    low: np.ndarray
    back: np.ndarray
    size: np.ndarray


class Index:
    """One shard's two-way FM-index."""

    def __init__(self, words: pa.Array, forward: bytes, backward: bytes):
        self.words = words
        self.sides = [np.frombuffer(x, np.int32) for x in (forward, backward)]
        counts = np.bincount(self.sides[0], minlength=len(words) + 1)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.n = len(self.sides[0])
        self._next: list[np.ndarray | None] = [None, None]
        self.inner = [np.zeros(self.n + 1, np.int32) for _ in self.sides]
        for inner, side in zip(self.inner, self.sides):
            np.cumsum(side > 0, dtype=np.int32, out=inner[1:])

    def _step(self, side: int) -> np.ndarray:
        """For each row the row of the suffix one word longer: rows of a word keep their order."""
        if self._next[side] is None:
            # sorted in place, number and row in one word: both are below 2^31
            both = self.sides[side].astype(np.int64)
            both <<= 32
            both |= np.arange(self.n, dtype=np.int32)
            both.sort()
            both &= (1 << 32) - 1
            step = np.empty(self.n, np.int32)
            step[both] = np.arange(self.n, dtype=np.int32)
            self._next[side] = step
        return self._next[side]

    def slices(self, allowed: np.ndarray) -> Iterator[Intervals]:
        """The single words that are allowed, so many at a time that their rows are about SLICE_ROWS."""
        number = np.flatnonzero(allowed[1:]) + 1
        size = np.diff(self.start)[number]
        ends = np.cumsum(size)
        a = 0
        while a < len(number):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_ROWS, "right")))
            yield Intervals([number[a:b]], self.start[number[a:b]], self.start[number[a:b]], size[a:b])
            a = b

    def extend(self, phrases: Intervals, right: bool, allowed: np.ndarray) -> Intervals:
        """All phrases one word longer, to the left or to the right, by words that are allowed (indexed by word number)."""
        here, there = (phrases.back, phrases.low) if right else (phrases.low, phrases.back)
        owner = np.repeat(np.arange(len(here)), phrases.size)
        row = np.arange(len(owner)) + np.repeat(here - np.concatenate([[0], np.cumsum(phrases.size)[:-1]]), phrases.size)
        word = self.sides[int(right)][row].astype(np.int64)
        key = owner * np.int64(len(self.words) + 1) + word
        key, order = _ordered(key)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([head, [len(key)]]))
        first = order[head]
        owned, added = owner[first], word[first]
        # in the other transform the longer phrases of one phrase lie in order of the word added
        begins = np.concatenate([[0], np.cumsum(phrases.size)[:-1]])[owned]
        other = there[owned] + head - begins
        kept = np.flatnonzero((added > 0) & allowed[added])
        near, far, owned, added = self._step(int(right))[row[first[kept]]].astype(np.int64), other[kept], owned[kept], added[kept]
        words = [w[owned] for w in phrases.words]
        words = [*words, added] if right else [added, *words]
        return Intervals(words, far if right else near, near if right else far, size[kept])

    def neighbours(self, phrases: Intervals) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences with a word before, and with a word after, inside their piece."""
        inside = lambda side, low: self.inner[side][low + phrases.size] - self.inner[side][low]
        return inside(0, phrases.low), inside(1, phrases.back)


def _salted(keys: np.ndarray, lang: str) -> np.ndarray:
    name = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return mix(keys + hashed(name, np.zeros(1, np.int64), np.array([len(name)]))[0])


def _chain(keys: list[np.ndarray]) -> np.ndarray:
    out = keys[0]
    for k in keys[1:]:
        out = mix(out * _A + k)
    return out


def _text_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The filter's keys of phrases (lang, phrase), all of one length."""
    langs = batch.column(0).dictionary_encode()
    codes, out = langs.indices.to_numpy(), np.empty(batch.num_rows, np.uint64)
    for k, name in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(codes == k)
        words = split(batch.column(1).take(pa.array(mine)), GAPS)
        keys = _salted(words.keys(), name).reshape(len(mine), -1)
        out[mine] = _chain(list(keys.T))
    return out


PHRASES = "lang string, phrase string, n long, n_left long, n_right long"


def phrases(index: DataFrame, size: int, filters: list | None = None) -> DataFrame:
    """(lang, phrase, n, n_left, n_right) of each shard: its phrases of `size` words.

    n_left and n_right are the occurrences that have a word before and after inside the piece.
    filters[k] (a broadcast Bloom filter) holds the phrases of k + 1 words that are frequent over all
    shards; phrases with a part that it does not hold are left out. Shards are taken one at a time.
    """
    filters = filters or []

    def enumerate_shard(lang: str, fm: Index) -> Iterator[pa.RecordBatch]:
        allowed = np.ones(len(fm.words) + 1, bool)
        keys = np.empty(0, np.uint64)
        if filters:
            split_words = split(fm.words, GAPS)
            keys = np.concatenate([[np.uint64(0)], _salted(split_words.keys(), lang)])
            allowed[1:] = bloom.holds(filters[0].value, keys[1:])
        for now in fm.slices(allowed):
            for k in range(1, size):
                # to the left first, then to the right in turn: both transforms serve
                now = fm.extend(now, right=k % 2 == 0, allowed=allowed)
                if k < size - 1 and len(filters) > k:
                    now = _kept(now, bloom.holds(filters[k].value, _chain([keys[w] for w in now.words])))
                elif k == size - 1 and len(filters) > k - 1 >= 1:
                    # both parts one word shorter
                    for part in (now.words[:-1], now.words[1:]):
                        now = _kept(now, bloom.holds(filters[k - 1].value, _chain([keys[w] for w in part])))
            left, right = fm.neighbours(now)
            for a in range(0, len(now.size), CHUNK):
                cut = slice(a, a + CHUNK)
                texts = [fm.words.take(pa.array(w[cut] - 1)) for w in now.words]
                phrase = pc.binary_join_element_wise(*texts, " ") if size > 1 else texts[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(phrase), np.int8))), phrase, *[pa.array(x[cut].astype(np.int64)) for x in (now.size, left, right)]], ["lang", "phrase", "n", "n_left", "n_right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1).slice(k, 1).flatten()
                yield from enumerate_shard(batch.column(0)[k].as_py(), Index(words, batch.column(2)[k].as_buffer(), batch.column(3)[k].as_buffer()))

    return index.select("lang", "words", "forward", "backward").mapInArrow(run, PHRASES)


def _kept(now: Intervals, keep: np.ndarray) -> Intervals:
    return now if keep.all() else Intervals([w[keep] for w in now.words], now.low[keep], now.back[keep], now.size[keep])


@contextmanager
def _rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside read and send so many rows at a time to Python: shards and long texts are large rows."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def frequent_phrases(index: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> list[DataFrame]:
    """For each length 1..max_words the phrases found at least `least` times, summed over shards."""
    out, filters = [], []
    context = index.sparkSession.sparkContext
    for size in range(1, max_words + 1):
        # a shard has one row for a phrase, so rows go straight to where they are summed
        dealt = phrases(index, size, filters).repartition("lang", "phrase")
        summed = dealt.groupBy("lang", "phrase").agg(*[F.sum(c).alias(c) for c in ("n", "n_left", "n_right")]).where(F.col("n") >= least)
        with _rows_a_batch(index.sparkSession, 1):  # a shard at a time
            found = stored(summed, f"phrases-{size}")
        out.append(found)
        if size < max_words:
            held, _ = bloom.once_and_twice(found.select("lang", "phrase"), lambda batch: [_text_keys(batch)] if batch.num_rows else [], bloom.bits_for(found.count()))
            filters.append(context.broadcast(held))
    return out


def _part(words: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, n_left and n_right of each language's first phrases.

    Texts (A-Z in lower case; null: empty) are cut into pieces at `. , ; : ! ?` and line ends, pieces
    into words at blanks and tabs; a null lang is `und`. Candidates are phrases of 2..max_words
    words found at least `least` times, a. Cut in two, their parts are found l and r times; the cut
    with the lowest floor(1000000 * a * a / (l * r)), the earliest of equal ones, gives l, r and the
    score. A candidate contained in a longer one with 100 * f(longer) >= share * a is dropped. The
    first `top` of each language by score, a and phrase (UTF-8 order) stay; n counts its words.
    Repeated rows count each; only the two named columns are read; without words there are no rows.
    """
    with _rows_a_batch(docs.sparkSession, 1000):
        index = stored(build_index(docs, text, lang, max_words), "phrase-index")
    by_size = frequent_phrases(index, max_words, least)
    totals = index.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = F.split("phrase", " ")
    kept = []
    for size in range(2, max_words + 1):
        scored = by_size[size - 1].withColumnRenamed("n", "a")
        cuts = []
        for k in range(1, size):
            for name, first, length in (("l", 1, k), ("r", k + 1, size - k)):
                # a frequent word is a part of very many phrases: Spark splits the left side of a left join
                part = by_size[length - 1].select("lang", F.col("phrase").alias(f"{name}{k}_phrase"), F.col("n").alias(f"{name}{k}"))
                scored = scored.withColumn(f"{name}{k}_phrase", _part(words, first, length)).join(part, ["lang", f"{name}{k}_phrase"], "left").drop(f"{name}{k}_phrase")
            wide = lambda c: F.col(c).cast("decimal(38,0)")
            score = F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)"), (F.col(f"l{k}").cast("decimal(19,0)") * F.col(f"r{k}").cast("decimal(19,0)")))
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        scored = scored.withColumn("cut", F.array_min(F.array(*cuts)))
        if size < max_words:
            # what contains a phrase contains it with one more word, which is found no less often
            longer = by_size[size].select("lang", "n", F.explode(F.array(_part(words, 1, size), _part(words, 2, size))).alias("phrase"))
            scored = scored.join(longer.groupBy("lang", "phrase").agg(F.max("n").alias("most")), ["lang", "phrase"], "left")
            scored = scored.where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
        kept.append(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "n_left", "n_right"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # a language may hold nearly all phrases: its parts are ranked first, and only their heads together
    heads = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", place("lang", "part")).where(F.col("rank") <= top)
    ranked = heads.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "n_left", "n_right")


def oracle_sql() -> str:
    """The rows of op11, but for the neighbours' counts, for engines with lists and 128-bit integers."""
    gram = lambda k: f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase, count(*) AS n FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM p WHERE len(ws) >= {k}) GROUP BY ALL"
    score = "(1000000::HUGEINT * a * a) // (l::HUGEINT * r)"
    return f"""WITH p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g1 AS MATERIALIZED (SELECT * FROM ({gram(1)}) WHERE n >= {LEAST}), g2 AS MATERIALIZED (SELECT * FROM ({gram(2)}) WHERE n >= {LEAST}), g3 AS MATERIALIZED (SELECT * FROM ({gram(3)}) WHERE n >= {LEAST}),
c AS (SELECT lang, phrase, n AS a, 1 AS k, split_part(phrase, ' ', 1) AS lp, split_part(phrase, ' ', 2) AS rp FROM g2
  UNION ALL SELECT lang, phrase, n, 1, split_part(phrase, ' ', 1), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM g3
  UNION ALL SELECT lang, phrase, n, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM g3),
f AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2),
s AS (SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r FROM c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
b AS (SELECT lang, phrase, a, l, r, ({score})::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY {score}, k) = 1),
longer AS (SELECT lang, phrase, max(n) AS most FROM (SELECT lang, n, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase FROM g3
  UNION ALL SELECT lang, n, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM g3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n, score FROM b JOIN t ON t.lang = b.lang LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
WHERE most IS NULL OR 100 * most < {SHARE} * a QUALIFY rank <= {TOP}"""
