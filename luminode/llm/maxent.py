"""Language-model scoring: a hashed maximum-entropy model over a counted vocabulary.

The probability of a word is a product of softmax factors: P(class | history) * P(leaf | class,
history) * P(word | leaf, history). The first two have hashed features of the words before: the
last word, the pair of last words, and two skip features; their weights are learned by distributed
gradient updates and travel with the tasks. Leaves are single words for the most frequent ones,
and groups by word ending for all others: one of frequent words, one of rarer words.

A frequent word has its share of its group. Rarer words, however many the corpus has, lie in
cells: parts of a group by word hash, so many that each has about CELL_TOKENS tokens. A cell's
n-gram features are all pairs (word before, word) that the training text holds; cells, words and
pairs grow with the corpus and stay in tables that Spark deals out by cell. Every pair has a
weight of its own, so the regularised likelihood (each expectation may stay DISCOUNT below its
count) is highest where P(word | cell, before) = (n(before, word) - DISCOUNT + rest * share) /
n(before): that closed form takes the place of gradient steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminode.llm.common import fold, stored
from luminode.llm.words import Lookup, pieces, split

FOLDS, HELD_OUT = 5, 1
#: Frequent words; with the endings and the start sign, codes fill 16 bits.
HOT_WORDS = 65_280
ENDINGS = 128
START = HOT_WORDS + ENDINGS
CLASSES, PLACES = 16, 32
#: Leaves of their own; the other 2 * ENDINGS leaves are groups.
SINGLE_WORDS = CLASSES * PLACES - 2 * ENDINGS
#: Words that the features of the first two factors tell apart; of others they see the ending.
CONTEXT_WORDS = 4096
#: Feature templates of the class factor and of the leaf factor: (distances back, buckets).
CLASS_FEATURES = (((1,), 8192), ((2,), 4096), ((1, 2), 8192), ((3,), 4096))
LEAF_FEATURES = (((1,), 512), ((2,), 256))
ROUNDS = 3
DAMPING = 1.0
#: Tokens of rarer words in a cell; bounds the arrays of the task that reads it.
CELL_TOKENS = 2_000_000
DISCOUNT = 0.75
#: Key of the end of a text; the low bits of a word's key tell its ending.
END_KEY = np.uint64(1)
COUNT_TOKENS = 4_000_000
CHUNK_TOKENS = 20_000
#: Weights summed up together.
PART = 8192
_ODD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def keyed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of some texts, and the first token of each text (and the number of all).

    Tokens are blank-separated words with A-Z in lower case, then one end. The lowest bits of a
    word's key are replaced by a number of its last two bytes, its ending.
    """
    words = split(texts)
    last, short = words.data[words.stop - 1].astype(np.uint32), words.stop - words.start < 2
    before = np.where(short, 0, words.data[np.maximum(words.stop, 2) - 2]).astype(np.uint32)
    end = ((last * np.uint32(_ODD[0]) ^ before * np.uint32(_ODD[1])) >> np.uint32(25)).astype(np.uint64)
    keys = words.keys() & ~np.uint64(ENDINGS - 1) | end
    return np.insert(keys, words.first[1:], END_KEY), words.first + np.arange(len(words.first))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of every distinct token of the documents, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        held: list[np.ndarray] = []
        for batch in batches:
            for texts in pieces(batch.column(0)):
                held.append(keyed(texts)[0])
                if sum(map(len, held)) > COUNT_TOKENS:
                    yield out()
                    held = []
        if held:
            yield out()

    partial = docs.select(text).mapInArrow(count, "key long, n long")
    return stored(partial.groupBy("key").agg(F.sum("n").alias("n")), "words")


@dataclass
class Model:
    """What tasks need of the vocabulary and the first two factors; its size is fixed.

    Everything that grows with the corpus stays in the table of encoded documents.
    """

    hot: Lookup  # word key -> code
    hot_log: np.ndarray  # log10(count + 0.5) by code; 0 for rarer words
    leaf: np.ndarray  # leaf of each code
    inside: np.ndarray  # log10 share in the leaf; of rarer words what is left of it beside the cell
    context: np.ndarray  # what features see of each code
    cells: np.ndarray  # cells of each ending's rarer words
    bias: list[np.ndarray]
    weights: list[list[np.ndarray]] = field(default_factory=list)
    tokens: int = 0
    distinct: int = 0

    def cell(self, codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum(self.cells)[:-1]])
        end = codes.astype(np.int64) - HOT_WORDS
        return first[end] + ((keys >> np.uint64(32)) % self.cells[end].astype(np.uint64)).astype(np.int64)


def build(words: DataFrame) -> Model:
    """Collects totals, at most HOT_WORDS counts and two numbers per ending from the word table."""
    totals = np.zeros((2, ENDINGS))
    for r in words.groupBy(F.col("key").bitwiseAND(F.lit(ENDINGS - 1)).cast("int").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        totals[:, r.ending] = r.n, r.words
    level = F.floor(8 * F.log2("n")).cast("int")
    least, room = None, HOT_WORDS
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        room -= r.words
        if room < 0:
            break
        least = r.level
    found = [] if least is None else sorted(((r.n, r.key) for r in words.where(level >= least).collect()), key=lambda r: (-r[0], r[1]))
    n = np.array([x for x, _ in found], np.float64)
    keys = np.array([k for _, k in found], np.int64).view(np.uint64)
    ends = (keys & np.uint64(ENDINGS - 1)).astype(np.int64)
    single, grouped = slice(0, SINGLE_WORDS), slice(SINGLE_WORDS, None)
    rare = totals - np.stack([np.bincount(ends, n, ENDINGS), np.bincount(ends, minlength=ENDINGS)])
    cells = np.maximum(1, np.ceil(rare[0] / CELL_TOKENS)).astype(np.int64)
    # a half for each word, and one for the unknown words of each cell
    hot_mass = np.bincount(ends[grouped], n[grouped] + 0.5, ENDINGS)
    rare_mass = rare[0] + 0.5 * rare[1] + 0.5 * cells
    masses = np.zeros(CLASSES * PLACES)
    masses[: len(n[single])] = n[single] + 0.5
    masses[SINGLE_WORDS : SINGLE_WORDS + ENDINGS] = hot_mass
    masses[SINGLE_WORDS + ENDINGS :] = rare_mass
    # leaves go to classes by mass, so that a class holds leaves of like frequency
    number = np.empty(len(masses), np.int64)
    number[np.argsort(-masses, kind="stable")] = np.arange(len(masses))
    leaf = np.zeros(START + 1, np.int64)
    leaf[: len(n)] = np.concatenate([np.arange(len(n[single])), SINGLE_WORDS + ends[grouped]])
    leaf[HOT_WORDS:START] = SINGLE_WORDS + ENDINGS + np.arange(ENDINGS)
    inside = np.zeros(START + 1)
    inside[SINGLE_WORDS : len(n)] = np.log10(n[grouped] + 0.5) - np.log10(hot_mass[ends[grouped]])
    inside[HOT_WORDS:START] = -np.log10(rare_mass)
    hot_log = np.zeros(START + 1)
    hot_log[: len(n)] = np.log10(n + 0.5)
    context = np.arange(START + 1, dtype=np.uint32)
    context[CONTEXT_WORDS : len(n)] = HOT_WORDS + ends[CONTEXT_WORDS:]
    shares = np.zeros(CLASSES * PLACES)
    shares[number] = masses
    shares = shares.reshape(CLASSES, PLACES)
    with np.errstate(divide="ignore"):
        bias = [np.log(shares.sum(axis=1) / shares.sum()), np.log(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-30))]
    bias = [np.maximum(b, -60).astype(np.float32) for b in bias]
    weights = [[np.zeros((size, CLASSES), np.float32) for _, size in CLASS_FEATURES], [np.zeros((size * CLASSES, PLACES), np.float32) for _, size in LEAF_FEATURES]]
    return Model(Lookup(keys), hot_log, number[leaf].astype(np.int32), inside, context, cells, bias, weights, int(totals[0].sum()), int(totals[1].sum()))


def encode(docs: DataFrame, model: Model, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each document as numbers: (row, doc_id, learn, codes, keys, before).

    codes has 16 bits per token; keys (64 bits) and before (32 bits of the key of the word before)
    have one entry per token that is no frequent word. All later passes read this table.
    """
    names = ["row", "doc_id", "learn", "codes", "keys", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            start = 0
            for texts in pieces(batch.column(2)):
                keys, first = keyed(texts)
                code = model.hot(keys)
                rare = np.flatnonzero(code < 0)
                code[rare] = HOT_WORDS + (keys[rare] & np.uint64(ENDINGS - 1)).astype(np.int32)
                # 0 stands before the first word
                before = np.where(np.isin(rare, first), 0, keys[rare - 1] >> np.uint64(32)).astype(np.uint32)
                cuts, rares = first, np.searchsorted(rare, first)
                cut = lambda x, at, size: pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((at * size).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
                columns = [cut(code.astype(np.uint16), cuts, 2), cut(keys[rare], rares, 8), cut(before, rares, 4)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0).slice(start, n), batch.column(1).slice(start, n), *columns], names)
                row, start = row + n, start + n

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), learn.alias("learn"), F.col(text))
    return stored(chosen.mapInArrow(run, "row long, doc_id long, learn boolean, codes binary, keys binary, before binary"), "encoded")


def _flat(codes: pa.Array) -> np.ndarray:
    """The codes of several documents, three start signs before each."""
    begin = np.full(3, START, np.uint16).tobytes()
    return np.frombuffer(b"".join(x for c in codes for x in (begin, c.as_py())), np.uint16)


def _slices(flat: np.ndarray) -> Iterator[np.ndarray]:
    """Places of tokens, some at a time; a long document is taken in several slices."""
    places = np.flatnonzero(flat != START)
    for k in range(0, len(places), CHUNK_TOKENS):
        yield places[k : k + CHUNK_TOKENS]


def _buckets(context: np.ndarray, at: np.ndarray, templates) -> list[np.ndarray]:
    """Bucket of each template's feature at each place."""
    back = {d: context[at - d] for d in sorted({d for distances, _ in templates for d in distances})}
    out = []
    for distances, size in templates:
        mixed = np.zeros(len(at), np.uint32)
        for odd, d in zip(_ODD, distances):
            mixed = (mixed ^ back[d]) * np.uint32(odd)
            mixed ^= mixed >> np.uint32(15)
        out.append((mixed & np.uint32(size - 1)).astype(np.uint16))
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def predict(model: Model, flat: np.ndarray, context: np.ndarray, at: np.ndarray):
    """Class and place of each token's leaf, its features, and both factors' distributions."""
    leaf = model.leaf[flat[at]]
    classes, places = leaf // PLACES, leaf % PLACES
    first = _buckets(context, at, CLASS_FEATURES)
    second = [f * np.uint16(CLASSES) + classes.astype(np.uint16) for f in _buckets(context, at, LEAF_FEATURES)]
    scores = np.repeat(model.bias[0][None], len(at), axis=0)
    for f, w in zip(first, model.weights[0]):
        scores += w[f]
    inside = model.bias[1][classes]
    for f, w in zip(second, model.weights[1]):
        inside += w[f]
    return classes, places, first, second, _softmax(scores), _softmax(inside)


def gradient(encoded: DataFrame, model: Model) -> np.ndarray:
    """How often each feature met each outcome, and how often the model expects it (two rows).

    Tasks add up their own tokens, in parts of PART weights that are then summed part by part.
    The difference of the two sums is the gradient of the log likelihood.
    """
    sizes = [w.size for factor in model.weights for w in factor]
    parts = -(-sum(sizes) // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, expected = [np.zeros(s, np.int64) for s in sizes], [np.zeros(s) for s in sizes]
        for batch in batches:
            flat = _flat(batch.column(0))
            context = model.context[flat]
            for at in _slices(flat):
                classes, places, first, second, p, q = predict(model, flat, context, at)
                for k, (f, prob, outcome, width) in enumerate([(f, p, classes, CLASSES) for f in first] + [(f, q, places, PLACES) for f in second]):
                    order = np.argsort(f, kind="stable")
                    ordered = f[order]
                    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                    expected[k].reshape(-1, width)[ordered[begin]] += np.add.reduceat(prob[order], begin, axis=0)
                    seen[k] += np.bincount(f.astype(np.int64) * width + outcome, minlength=sizes[k])
        both = np.zeros((2, parts * PART))
        both[0, : sum(sizes)], both[1, : sum(sizes)] = np.concatenate(seen), np.concatenate(expected)
        cut = both.reshape(2, parts, PART)
        used = np.flatnonzero(cut.any(axis=(0, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array([x[k].astype(np.float32).tobytes() for k in used], pa.binary()) for x in cut]], ["part", "seen", "expected"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, *sums in zip(*(c.to_pylist() for c in batch.columns)):
                total[part] = total.get(part, 0) + np.stack([np.frombuffer(x, np.float32).astype(np.float64) for x in sums])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array([x[k].tobytes() for x in total.values()], pa.binary()) for k in (0, 1)]], ["part", "seen", "expected"])

    kinds = "part int, seen binary, expected binary"
    out = np.zeros((2, parts * PART))
    for r in encoded.select("codes").mapInArrow(run, kinds).repartition("part").mapInArrow(add, kinds).toLocalIterator():
        out[0, r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.seen)
        out[1, r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.expected)
    return out[:, : sum(sizes)]


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """One pass over the documents to learn from, in `rounds` batches, each a distributed gradient.

    A weight moves by log((seen + damping) / (expected + damping)) over the number of templates,
    which keeps the steps of rare features small.
    """
    batch = F.pmod(F.xxhash64("row"), F.lit(rounds))
    for k in range(rounds):
        seen, expected = gradient(encoded.where(F.col("learn") & (batch == k)), model)
        step, at = np.log((seen + DAMPING) / (expected + DAMPING)), 0
        for factor in model.weights:
            for w in factor:
                w += (step[at : at + w.size].reshape(w.shape) / len(factor)).astype(np.float32)
                at += w.size
    return model


def cell_logs(keys: np.ndarray, before: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a cell: its word's training count, and log10 of mass * P(word | cell, before).

    The mass of a cell is its training tokens, a half for each of its words and one for all unknown ones.
    """
    _, word = np.unique(keys, return_inverse=True)
    contexts, last = np.unique(before, return_inverse=True)
    pairs, pair = np.unique(word * len(contexts) + last, return_inverse=True)
    n_word = np.bincount(word[learned], minlength=word.max() + 1)
    n_last = np.bincount(last[learned], minlength=len(contexts))
    n_pair = np.bincount(pair[learned], minlength=len(pairs))
    kinds = np.bincount(pairs[n_pair > 0] % len(contexts), minlength=len(contexts))
    mass = n_word.sum() + 0.5 * (n_word > 0).sum() + 0.5
    share = (n_word[word] + 0.5) / mass
    n, least = n_last[last], np.maximum(n_last[last], 1)
    after = (np.maximum(n_pair[pair] - DISCOUNT, 0) + DISCOUNT * kinds[last] * share) / least
    return n_word[word], np.log10(mass * np.where(n > 0, after, share))


def rare_words(encoded: DataFrame, model: Model) -> DataFrame:
    """(row, known, count_log, cell_log): sums over the tokens of each document that are no frequent words.

    Tokens go to their cell in blocks, one per batch and cell. No word of a cell has a greater
    share of the tokens than 1 / HOT_WORDS, so no cell is much larger than the others.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            join = lambda k, kind: np.frombuffer(b"".join(batch.column(k).to_pylist()), kind)
            codes, keys, before = join(2, np.uint16), join(3, np.uint64), join(4, np.uint32)
            sizes = np.array([len(x) // 8 for x in batch.column(3).to_pylist()], np.int64)
            owner = np.repeat(2 * batch.column(0).to_numpy() + batch.column(1).to_numpy(zero_copy_only=False), sizes)
            cell = model.cell(codes[codes >= HOT_WORDS], keys)
            order = np.argsort(cell, kind="stable")
            used, begin = np.unique(cell[order], return_index=True)
            blocks = [[x[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(order)])] for x in (keys[order], before[order], owner[order])]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(x, pa.binary()) for x in blocks]], ["cell", "keys", "before", "owner"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: list[tuple]) -> pa.RecordBatch:
            keys, before, owner = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), (np.uint64, np.uint32, np.int64)))
            n, log = cell_logs(keys, before, (owner & 1).astype(bool))
            rows, at = np.unique(owner >> 1, return_inverse=True)
            sums = [np.bincount(at, n > 0, len(rows)).astype(np.int64), np.bincount(at, np.log10(n + 0.5), len(rows)), np.bincount(at, log, len(rows))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, *sums)], ["row", "known", "count_log", "cell_log"])

        cell, held = None, []
        for batch in batches:
            for now, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if now != cell and held:
                    yield finish(held)
                    held = []
                cell = now
                held.append(block)
        if held:
            yield finish(held)

    dealt = encoded.select("row", "learn", "codes", "keys", "before").mapInArrow(deal, "cell long, keys binary, before binary, owner binary")
    looked = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(look_up, "row long, known long, count_log double, cell_log double")
    return looked.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "count_log", "cell_log")])


def frequent_words(encoded: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, n_tokens, hot, hot_log, leaf_log) of each document, in sparse batches."""
    fields = ["row", "doc_id", "n_tokens", "hot", "hot_log", "leaf_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = _flat(batch.column(2))
            context, log = model.context[flat], np.zeros(len(flat))
            for at in _slices(flat):
                classes, places, _, _, p, q = predict(model, flat, context, at)
                row = np.arange(len(at))
                log[at] = np.log10(np.maximum(p[row, classes] * q[row, places], 1e-30)) + model.inside[flat[at]]
            sizes = np.array([len(x) // 2 + 3 for x in batch.column(2).to_pylist()])
            begin = np.cumsum(sizes) - sizes
            sums = [sizes - 3, np.add.reduceat((flat < HOT_WORDS).astype(np.int64), begin), np.add.reduceat(model.hot_log[flat], begin), np.add.reduceat(log, begin)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sums)], fields)

    return encoded.select("row", "doc_id", "codes").mapInArrow(run, "row long, doc_id long, n_tokens long, hot long, hot_log double, leaf_log double")


def score_documents(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of each document.

    The model is trained on the documents where `learn` holds (null: not); all are scored.
    base_score sums the smoothed unigram log10 probabilities, score the model's. A null text is an
    empty one: only its end is scored. Rows that repeat an id are learned from and scored each for
    itself; a null id passes. Only the two named columns are read, whatever else the table has;
    an empty table gives an empty result. Words are told apart by 64-bit keys.
    """
    learn = F.coalesce(learn, F.lit(False))
    model = build(count_words(docs.where(learn), text))
    encoded = encode(docs, model, learn, doc_id, text)
    train(encoded, model)
    total = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    flags = encoded.select("row", "learn")
    out = frequent_words(encoded, model).join(flags, "row").join(rare_words(encoded, model), "row", "left")
    or_none = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id",
        "learn",
        "n_tokens",
        (F.col("hot") + or_none("known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_log") + or_none("count_log") - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("leaf_log") + or_none("cell_log")).alias("score"),
    )


def learning(doc_id: str = "doc_id") -> Column:
    """Whether a document is learned from: crc32 of the id modulo 5 is not 1; a null id is."""
    return fold(F.col(doc_id), FOLDS) != HELD_OUT
