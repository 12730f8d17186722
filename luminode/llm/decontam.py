"""Benchmark decontamination by a positional inverted index over the training documents.

Documents are indexed in shards of some megabytes: a row per shard and term holds the term's
postings, the positions at which it stands, in order. Terms that no test item uses cannot take part
in a match and have no list. A search first reads the lists of the RARE rarest terms of each window
only: the positions of the rarest one, less its offset, are the possible starts, and the next lists,
adjusted by their offsets, are intersected with them. The lists of commoner terms are read only for
shards and windows that are left, again from the rarest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from luminode.llm.common import free_names, stored
from luminode.llm.words import SIGNS, Lookup, pieces, split

WINDOW = 13
#: Terms of each window whose lists are read first, and that a proximity match needs.
RARE = 3
#: A proximity match has the other rare terms of a window this close to the rarest one, in words.
WITHIN = 12
#: Words of test items searched for at once; a larger set is taken in blocks of this size.
BLOCK_WORDS = 500_000
#: Starts tried at once in a shard.
TRIES = 2_000_000
#: Rows of a shard's index that hold no term: its documents' first positions, and its candidates.
FIRST, CANDIDATES = -1, -2

#: Byte table of the contract's words: A-Z to lower case, ASCII that is no digit or letter to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | None, fold: bytes = _FOLD) -> list[bytes]:
    return text.encode().translate(fold).split() if text else []


class Block:
    """Windows of some test items over a vocabulary of their words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        windows: dict[tuple, None] = {}
        for name, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            size = min(width, len(ids))
            windows.update(dict.fromkeys((number[name], *ids[k : k + size]) for k in range(len(ids) - size + 1)) if size else {})
        self.item = np.array([w[0] for w in windows], np.int64)
        self.length = np.array([len(w) - 1 for w in windows], np.int64)
        self.width = int(self.length.max()) if len(self.length) else 1
        self.terms = np.full((len(windows), self.width), -1, np.int32)
        for row, w in zip(self.terms, windows):
            row[: len(w) - 1] = w[1:]
        self.size = len(vocabulary)
        self.lookup = Lookup(split(pa.array(list(vocabulary), pa.binary()).cast(pa.string()), SIGNS).keys() if vocabulary else np.empty(0, np.uint64))

    def rank(self, counts: np.ndarray) -> None:
        """Orders each window's terms from the rarest; terms and offsets follow that order."""
        last = np.iinfo(np.int64).max
        order = np.argsort(np.where(self.terms >= 0, counts[self.terms], last), axis=1, kind="stable") if len(self.terms) else np.zeros(self.terms.shape, np.int64)
        self.offsets = order.astype(np.int64)
        self.terms = np.take_along_axis(self.terms, order, 1).astype(np.int64)
        self.rare = np.unique(self.terms[:, :RARE])
        self.rare = self.rare[self.rare >= 0]


def _blocks(items: DataFrame, item_id: str, text: str, width: int, size: int) -> Iterator[Block]:
    """Test items are a stated query set: they pass through the driver block by block, each bounded."""
    held, n = [], 0
    for name, body in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        words = words_of(body)
        if words:
            held.append((name, words))
            n += len(words)
        if n >= size:
            yield Block(held, width)
            held, n = [], 0
    yield Block(held, width)


def build_index(docs: DataFrame, block: Block, text: str, drop_text: bool = True) -> tuple[DataFrame, DataFrame, str, str]:
    """Stores documents and postings in one pass: (documents, index, names of row number and word count).

    documents are the input's columns (without the text where drop_text is set), a row number and
    the number of words; index has (shard, term, n, places). Row numbers of a shard follow each
    other from the shard's number on. places are gaps, 32 bits each; between documents are gaps
    that no window spans.
    """
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    row, count, shard, term, n, places = free_names([f.name for f in kept], "row", "words", "shard", "term", "n", "places")
    names = [*[f.name for f in kept], row, count, shard, term, n, places]
    space = block.width + WITHIN + 1
    at_text = docs.columns.index(text)
    at_kept = [k for k, f in enumerate(docs.schema.fields) if f in kept]
    lookup = block.lookup

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            start = 0
            for texts in pieces(batch.column(at_text)):
                size, words = len(texts), split(texts, SIGNS)
                own, n_words = lookup(words.keys()), np.diff(words.first)
                first = np.cumsum(n_words + space) - n_words
                place = np.arange(len(own)) + np.repeat(first - words.first[:-1], n_words)
                used = np.flatnonzero(own >= 0)
                used = used[np.argsort(own[used], kind="stable")]
                terms, begin = np.unique(own[used], return_index=True)
                ends = np.append(begin[1:], len(used))
                gaps = np.diff(place[used], prepend=0)
                gaps[begin] = place[used][begin]
                lists = [gaps[a:b].astype(np.int32).tobytes() for a, b in zip(begin.tolist(), ends.tolist())]
                columns = [batch.column(k).slice(start, size) for k in at_kept]
                none = lambda m: [pa.nulls(m, x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(number, number + size)), pa.array(n_words), *none(size)], names)
                m = len(terms) + 1
                posted = [pa.array(np.full(m, number)), pa.array(np.append(terms, FIRST), pa.int32()), pa.array(np.append(ends - begin, 0)), pa.array([*lists, first.astype(np.int32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(m, c.type) for c in columns], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *posted], names)
                number, start = number + size, start + size

    fields = [T.StructField(f.name, f.dataType, True) for f in kept] + [T.StructField(x, k, True) for x, k in zip(names[-6:], (T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), T.BinaryType()))]
    both = stored(docs.mapInArrow(run, T.StructType(fields)), "postings")
    index = both.where(F.col(shard).isNotNull()).select(*[F.col(x).alias(y) for x, y in zip((shard, term, n, places), ("shard", "term", "n", "places"))])
    return both.where(F.col(row).isNotNull()).select(*names[:-4]), index, row, count


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Postings of each term over all documents; at most one number per vocabulary term reaches the driver."""
    out = np.zeros(size, np.int64)
    for term, n in index.where(F.col("term") >= 0).groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class Lists:
    """The postings lists of a shard, as one ascending array of term and place."""

    def __init__(self, terms: list[int], places: list[bytes]):
        sizes = np.array([len(x) // 4 for x in places], np.int64)
        steps = np.frombuffer(b"".join(places), np.int32).astype(np.int64)
        run, begin = np.cumsum(steps), np.cumsum(sizes) - sizes
        place = run - np.repeat(run[begin] - steps[begin], sizes) if len(steps) else run
        self.all = np.sort((np.repeat(np.array(terms, np.int64), sizes) << 32) | place)

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.all, terms << 32), np.searchsorted(self.all, (terms + 1) << 32)

    def next(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first place of each term from a place on; beyond all places where there is none."""
        at = np.searchsorted(self.all, (terms << 32) + np.maximum(places, 0))
        found = self.all[np.minimum(at, len(self.all) - 1)]
        return np.where((at < len(self.all)) & (found >> 32 == terms), found & 0xFFFFFFFF, 1 << 40)

    def intersect(self, block: Block, window: np.ndarray, start: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows and starts at which the window's terms of these ranks stand too."""
        for k in range(first, last):
            if not len(window):
                break
            want = start + block.offsets[window, k]
            keep = (block.length[window] <= k) | (self.next(block.terms[window, k], want) == want)
            window, start = window[keep], start[keep]
        return window, start


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    shard, rows = None, []
    for batch in batches:
        for now, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if now != shard and rows:
                yield shard, rows
                rows = []
            shard = now
            rows.append(row)
    if rows:
        yield shard, rows


def candidates(index: DataFrame, block: Block) -> DataFrame:
    """(shard, windows, starts, near): windows whose rare terms stand as they should, and proximity matches.

    near has pairs (document of the shard, item), 64 bits each.
    """
    spark = index.sparkSession
    # bounded by the words of a block
    rare = spark.createDataFrame(pa.table({"term": pa.array([FIRST, *block.rare.tolist()], pa.int32())}))
    lists = index.join(F.broadcast(rare), "term", "left_semi").select("shard", "term", "places")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            first = np.frombuffer(next(p for t, p in rows if t == FIRST), np.int32)
            held = [(t, p) for t, p in rows if t >= 0]
            if not held:
                continue
            lists = Lists([t for t, _ in held], [p for _, p in held])
            low, high = lists.bounds(block.terms[:, 0])
            tried, done = np.cumsum(high - low), []
            for cut in range(0, int(tried[-1]), TRIES):
                chosen = np.flatnonzero((tried > cut) & (tried <= cut + TRIES) & (high > low))
                many = (high - low)[chosen]
                window = np.repeat(chosen, many)
                place = lists.all[np.repeat(low[chosen], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] & 0xFFFFFFFF
                near = np.ones(len(window), bool)
                for k in range(1, min(RARE, block.width)):
                    near &= (block.length[window] <= k) | (lists.next(block.terms[window, k], place - WITHIN) <= place + WITHIN)
                window, place = window[near], place[near]
                pairs = np.unique(((np.searchsorted(first, place, "right") - 1) << 32) | block.item[window])
                done.append((*lists.intersect(block, window, place - block.offsets[window, 0], 1, min(RARE, block.width)), pairs))
            if done:
                found = [np.concatenate(x).astype(np.int64) for x in zip(*done)]
                if len(found[2]):
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), *[pa.array([x.tobytes()], pa.binary()) for x in found]], ["shard", "windows", "starts", "near"])

    return lists.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "shard long, windows binary, starts binary, near binary")


def matches(index: DataFrame, found: DataFrame, block: Block) -> DataFrame:
    """(row, items, spans, near) of the documents with a match: candidates held against their other terms."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = np.unique(block.terms[np.unique(np.frombuffer(windows, np.int64)), RARE:])
                terms = np.append(terms[terms >= 0], FIRST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard)), pa.array(terms, pa.int32())], ["shard", "term"])

    need = found.select("shard", "windows").mapInArrow(wanted, "shard long, term int")
    empty = F.lit(None).cast("binary")
    lists = index.join(need, ["shard", "term"], "left_semi").select("shard", "term", "places", empty.alias("starts"), empty.alias("near"))
    rows = lists.union(found.select("shard", F.lit(CANDIDATES), "windows", "starts", "near"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            first = np.frombuffer(next(r[1] for r in rows if r[0] == FIRST), np.int32).astype(np.int64)
            window, start, near = (np.frombuffer(x, np.int64) for x in next(r[1:] for r in rows if r[0] == CANDIDATES))
            held = [r for r in rows if r[0] >= 0]
            if held:
                window, start = Lists([r[0] for r in held], [r[1] for r in held]).intersect(block, window, start, RARE, block.width)
            # stretches of hit words: a window opens one place and closes another
            edge = np.concatenate([start, start + block.length[window]])
            places, at = np.unique(edge, return_inverse=True)
            depth = np.cumsum(np.bincount(at, np.repeat([1, -1], len(start)), len(places))) if len(places) else np.empty(0)
            inside = depth > 0
            begin = places[inside & ~np.concatenate([[False], inside[:-1]])]
            end = places[~inside & np.concatenate([[False], inside[:-1]])]
            where = np.searchsorted(first, begin, "right") - 1
            pairs = np.unique(((np.searchsorted(first, start, "right") - 1) << 32) | block.item[window])
            docs = np.unique(np.concatenate([where, near >> 32]))

            def grouped(owner: np.ndarray, values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.append(docs, np.iinfo(np.int64).max)), pa.int32()), values)

            name = lambda x: pa.array([block.names[k] for k in (x & 0xFFFFFFFF).tolist()], pa.string())
            spans = pa.StructArray.from_arrays([pa.array(x - first[where], pa.int32()) for x in (begin, end)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([pa.array(shard + docs), grouped(pairs >> 32, name(pairs)), grouped(where, spans), grouped(near >> 32, name(near))], ["row", "items", "spans", "near"])

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(check, f"row long, items array<string>, spans {_SPANS}, near array<string>")


ADDED = ("n_words", "n_hit", "items", "spans", "near")


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = False, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """Adds n_words, n_hit, items, spans and near to documents, each name after `prefix`.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A document word
    inside any occurrence of `window` consecutive words of an item (of all its words, where it has
    fewer) is hit; `items` lists, sorted as strings, the items with such an occurrence, `spans`
    the hit word ranges (end exclusive). `near` lists the items of which a window's rarest terms
    stand within WITHIN words of the rarest one, in whatever order. A null or empty text has no
    words; an item without words matches nothing; a null item id counts as the empty string; items
    with equal ids are one item. Repeated documents are judged each for itself. Columns that clash
    with the added ones are replaced. The text is dropped unless keep_text is set.
    """
    added = [prefix + c for c in ADDED]
    given = docs.select(*[docs[c] for c in docs.columns if c.lower() not in added or c == text])
    body, hits = None, []
    for block in _blocks(items, item_id, item_text, window, block_words):
        if body is None:
            body, index, row, count = build_index(given, block, text, drop_text=False if keep_text else True)
        else:  # the same rows, for the terms of further items
            _, index, _, _ = build_index(given.select(text), block, text)
        block.rank(term_counts(index, block.size))
        if len(block.rare):
            hits.append(matches(index, stored(candidates(index, block), "candidates"), block))
    if not hits:
        found = body.sparkSession.createDataFrame([], f"row long, items array<string>, spans {_SPANS}, near array<string>")
    elif len(hits) == 1:
        found = hits[0]
    else:
        for h in hits[1:]:
            hits[0] = hits[0].union(h)
        all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = hits[0].groupBy("row").agg(all_of("items").alias("items"), _merge(all_of("spans")).alias("spans"), all_of("near").alias("near"))
    names = free_names(body.columns, "r", "i", "s", "x")
    found = found.select(*[F.col(c).alias(n) for c, n in zip(("row", "items", "spans", "near"), names)])
    out = body.join(found, body[row] == found[names[0]], "left")
    or_none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    spans = or_none(names[2], _SPANS)
    values = [F.col(count), F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), or_none(names[1], "array<string>"), spans, or_none(names[3], "array<string>")]
    return out.select(*[body[c] for c in body.columns[:-2] if c.lower() not in added], *[v.alias(c) for v, c in zip(values, added)])


def _merge(spans):
    """Column: ordered, overlapping spans (of several blocks) as disjoint ones."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.when(F.size(spans) == 0, empty).otherwise(F.aggregate(spans, empty, step))


def contaminated(n_words="n_words", n_hit="n_hit"):
    """Column: the contract's rule, a twentieth of the words or more hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
