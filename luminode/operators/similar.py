"""Links between similar sets: SuperMinHash signatures, banding, verification on full sets, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.operators.components import connected_components
from luminode.sources.shared import stored

SLOTS = 160
ROWS = 5  # 32 bands of 5: a pair of similarity 0.8 shares none with probability 3e-6
SIMILARITY = 80  # per cent
#: A pair goes to verification unless so many standard deviations fewer slots agree than at the limit.
DEVIATIONS = 4.5
#: Members compared in one piece; a larger bucket is compared piece by piece.
PIECE = 256
CHUNK = 64
#: Sets of fewer elements are signed together, POOL elements at a time: they take many layers, each a few calls of numpy.
SMALL, POOL = 300, 64_000
#: Layers of a signature in which the permutation of slots is told from the swaps before, without a table of all slots.
SWAPS = 6

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    out = x >> np.uint64(30)
    out ^= x
    out *= _B
    out ^= out >> np.uint64(27)
    out *= _C
    out ^= out >> np.uint64(31)
    return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of a list of sets, one row each; rows of empty sets are all ones.

    Element e draws, layer after layer, a fraction and the next place of a random permutation of
    the slots; slot p keeps the least layer + fraction. A set is done when all of its slots are
    below the next layer (early stopping), which large sets are after one layer.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    top = np.uint64(2**64 - 1)
    values = np.full(len(sets) * slots, top)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    start = np.repeat(np.arange(len(sets)) * slots, sizes)  # of the values of an element's set
    kind = np.uint8 if slots <= 256 else np.int32
    swaps: list[tuple] = []  # of each layer before: the place swapped with, what then came there, and the slot drawn
    places = None
    for layer in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + np.uint64(int(_A) * (layer + 1) % 2**64))
        swap = drawn >> np.uint64(32)
        swap *= np.uint64(slots - layer)
        swap >>= np.uint64(32)
        swap = swap.astype(kind)
        swap += kind(layer)
        if places is None:
            # a place holds its own number, but where it was swapped with before; later swaps count
            slot, moved = swap, np.full(len(swap), layer, kind)
            for other, came, _ in swaps:
                slot = np.where(other == swap, came, slot)
                moved[other == layer] = came[other == layer]
            swaps.append((swap, moved, slot))
        else:
            at = np.arange(len(elements))
            slot = places[at, swap]
            places[at, swap] = places[:, layer]
            places[:, layer] = slot
        drawn &= np.uint64(0xFFFFFFFF)
        drawn |= np.uint64(layer << 32)
        np.minimum.at(values, start + slot, drawn)
        active = (values.reshape(-1, slots).max(axis=1) >> np.uint64(32)) > layer
        if not active.all():
            keep = np.repeat(active, sizes)
            sizes = np.where(active, sizes, 0)
            elements, start = elements[keep], start[keep]
            swaps = [tuple(x[keep] for x in swap) for swap in swaps]
            places = None if places is None else places[keep]
        if layer + 1 == SWAPS and len(elements):
            # what is left are small sets
            places, at = np.tile(np.arange(slots, dtype=kind), (len(elements), 1)), np.arange(len(elements))
            for n, (other, came, slot) in enumerate(swaps):
                places[at, other] = came
                places[:, n] = slot
            swaps = []
    return values.reshape(-1, slots)


def short_signatures(values: np.ndarray) -> np.ndarray:
    """16 scrambled bits of each slot: enough to compare and to band."""
    return (mix(values) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, sets_of, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, digest, signature) of each document; null digest and signature for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, marks = [], [], [None] * batch.num_rows
            pools, held = ([], []), [0, 0]  # (row, set) of small sets, and of others; their elements

            def flush(pool: list):
                for (row, _), short in zip(pool, short_signatures(superminhash([s for _, s in pool]))):
                    marks[row] = short.tobytes()
                pool.clear()

            for start in range(0, batch.num_rows, CHUNK):
                for row, s in enumerate(sets_of(batch.column(1).slice(start, CHUNK)), start):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        large = int(len(s) >= SMALL)
                        pools[large].append((row, s))
                        held[large] += len(s)
                        if held[large] >= POOL:
                            flush(pools[large])
                            held[large] = 0
            for pool in pools:
                flush(pool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n", "digest", "signature"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(sign, "doc_id long, n long, digest binary, signature binary")


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, band, id, n): a row for each class and band."""
    step = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(SLOTS // ROWS - 1))).alias("band")
    rows = classes.select("id", "n", "signature", band)
    return rows.select(F.xxhash64(F.expr(f"substring(signature, band * {step} + 1, {step})"), "band").alias("bucket"), "band", "id", "n")


def fits(a: str, b: str, similarity: float):
    """Sizes allow the similarity."""
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def verified(pairs: DataFrame, texts: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity.

    The text of b comes to that of a, which is repeated for every 256 partners, so that a centre
    with many partners is spread over tasks; a task holds the set of one centre at a time.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    partners = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")
    centres = size.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    rows = partners.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in (whole.slice(k, CHUNK) for whole in batches for k in range(0, whole.num_rows, CHUNK)):
            left, right = [], []
            for a, b, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets_of(batch.column(3))):
                if b is None:
                    centre, held = a, own
                elif a == centre:
                    both = int(np.isin(own, held, assume_unique=True).sum())
                    if 100 * both >= similarity * (len(own) + len(held) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def spread_factor(slots: int, largest: int = 4096) -> np.ndarray:
    """Variance of a SuperMinHash estimate over that of MinHash, by the size of the union (1 beyond the last)."""
    u = np.arange(largest + 1, dtype=float)[:, None]
    level = np.arange(1, slots, dtype=float)[None]
    power = lambda x: np.exp(u * (np.log(level / slots) + np.log(np.maximum(x, 1e-300) / (slots - 1))))
    terms = power(level + 1) + power(level - 1) - 2 * power(level)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1 - terms.sum(axis=1) * (slots - 1) / (u[:, 0] - 1)
    out[:2] = 0
    return np.clip(out, 0.0, 1.0)


def needed_slots(similarity: float, slots: int = SLOTS) -> np.ndarray:
    """Least number of equal slots of a pair worth verifying, by the size of its union at the limit."""
    limit = similarity / 100
    deviation = np.sqrt(limit * (1 - limit) / slots * spread_factor(slots))
    return np.floor(slots * (limit - DEVIATIONS * deviation)).astype(np.int64)


def _likely(left, right, band: int, similarity: float, needed: np.ndarray):
    """(k, js): for each left member the right ones that may be linked with it and are not yet.

    Sides are (ids, set sizes, components, signatures). A pair is seen in the first band it shares only.
    """
    (_, na, ca, sa), (_, nb, cb, sb) = left, right
    for k in range(len(na)):
        ok = (cb != ca[k]) & (100 * np.minimum(nb, na[k]) >= similarity * np.maximum(nb, na[k]))
        if left is right:
            ok[: k + 1] = False
        js = np.flatnonzero(ok)
        if len(js):
            equal = sb[js] == sa[k]
            union = ((na[k] + nb[js]) * 100 // (100 + similarity)).astype(np.int64).clip(max=len(needed) - 1)
            keep = equal.sum(axis=1) >= needed[union]
            js, equal = js[keep], equal[keep]
            js = js[equal.reshape(len(js), SLOTS // ROWS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(js):
            yield k, js


def _by_piece(batches: Iterator[pa.RecordBatch], keys: int = 4):
    """(key, rows of side 0, rows of side 1) of each piece; rows come ordered by their first `keys` columns."""
    key, sides = None, ([], [])
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if key:
                    yield key, *sides
                key, sides = row[:keys], ([], [])
            sides[row[keys]].append(row[keys + 1 :])
    if key:
        yield key, *sides


def _columns(side):
    ids, sizes, components, marks = list(zip(*side))[:4]
    return np.array(ids), np.array(sizes), np.array(components), np.stack([np.frombuffer(m, np.uint16) for m in marks])


_PIECE = ["bucket", "band", "p", "q"]


def _active(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows of pieces that have at least one likely partner; no pairs leave a task."""
    needed = needed_slots(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, zero, one in _by_piece(batches):
            if not zero or (key[2] != key[3] and not one):
                continue
            left = _columns(zero)
            right = _columns(one) if one else left
            used = (set(), set() if one else None)
            for k, js in _likely(left, right, key[1], similarity, needed):
                used[0].add(k)
                (used[1] if one else used[0]).update(js.tolist())
            for side, (members, chosen) in enumerate(zip((left, right), used)):
                out += [(*key, side, int(members[0][k])) for k in chosen or ()]
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], [*_PIECE, "side", "id"])

    ordered = rows.repartition("bucket", "p", "q").sortWithinPartitions(*_PIECE)
    return ordered.select(*_PIECE, "side", "id", "n", "component", "signature").mapInArrow(run, "bucket long, band int, p int, q int, side int, id long")


def _linked(rows: DataFrame, sets_of, similarity: float) -> DataFrame:
    """(a, b): components joined by a pair of members whose full sets reach the similarity.

    rows: those of _active with n, component, signature and text. Every likely pair of a piece is
    tested unless its components have met in the piece; sets are made once per member.
    """
    needed = needed_slots(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = []
        for key, zero, one in _by_piece(batches):
            if not zero or (key[2] != key[3] and not one):
                continue
            left = _columns(zero)
            right = _columns(one) if one else left
            sets = sets_of(pa.array([r[4] for r in zero], pa.string()))
            others = sets_of(pa.array([r[4] for r in one], pa.string())) if one else sets
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while x in above:
                    x = above[x]
                return x

            for k, js in _likely(left, right, key[1], similarity, needed):
                mine = sets[k]
                for j in js.tolist():
                    c, e = root(int(left[2][k])), root(int(right[2][j]))
                    if c == e:
                        continue
                    at = np.searchsorted(mine, others[j])
                    both = int((mine[np.minimum(at, len(mine) - 1)] == others[j]).sum())
                    if 100 * both >= similarity * (len(mine) + len(others[j]) - both):
                        above[max(c, e)] = min(c, e)
                        links.append((min(c, e), max(c, e)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    ordered = rows.repartition("bucket", "p", "q").sortWithinPartitions(*_PIECE)
    return ordered.select(*_PIECE, "side", "id", "n", "component", "signature", "text").mapInArrow(run, "a long, b long")


def _pieces(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets with several components, laid out so that members of different components meet in one piece pair.

    Members of a bucket's largest component need not meet each other: they are dealt to pieces once
    for every piece of the other members, which meet all pieces. A large group that is already one
    component is so repeated no more often than its bucket has pieces of strangers.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main")).where("size > main.n")
    blocks = lambda n: F.ceil(n / PIECE).cast("int")
    mixed = mixed.select("bucket", F.col("main.component").alias("main"), blocks(F.col("size") - F.col("main.n")).alias("others"), blocks(F.col("main.n")).alias("mains"))
    rows = placed.join(mixed, "bucket")
    is_main = F.col("component") == F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rows.withColumn("own", F.when(is_main, F.col("others") + deal(F.col("mains"))).otherwise(deal(F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    spread = rows.select("bucket", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "component")
    return spread.join(classes.select("id", "signature"), "id")


def link_classes(classes: DataFrame, texts: DataFrame, sets_of, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component) of the classes that are linked, links confirmed on full sets.

    First every class is compared with the leader (smallest id) it shares most buckets with. Then
    buckets that still hold several components are compared whole, in pieces: signatures tell which
    members have a likely partner in another component, their texts come to the piece, and every
    likely pair is tested on full sets there. Only links leave a task, at most one per member.

    classes: (id, n, signature), n the size of the set; texts: (id, text). sets_of gives
    the sorted distinct 64-bit hashes of each of some texts (an Arrow array); similarity is in per cent.
    """
    rows = banded(classes)
    leaders = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("leader"), F.count("*").alias("members")).where("members > 1")
    leaders = leaders.select("bucket", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"))
    members = stored(rows.join(leaders, "bucket"), "members")
    shared = members.where("id <> leader").where(fits("n", "leader_n", similarity)).groupBy("id", "leader").agg(F.count("*").alias("bands"))
    best = shared.groupBy("id").agg(F.max(F.struct("bands", (-F.col("leader")).alias("minus"))).alias("best"))
    pairs = stored(best.select((-F.col("best.minus")).alias("a"), F.col("id").alias("b")), "pairs")
    # texts of the classes that share a bucket with another; no other text can be asked for
    involved = stored(texts.join(members.select("id").distinct(), "id", "left_semi"), "involved")
    found = stored(connected_components(stored(verified(pairs, involved, sets_of, similarity), "verified")), "components")
    placed = members.join(found, "id", "left").select("bucket", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    pieces = stored(_pieces(placed, classes), "pieces")
    active = stored(_active(pieces, similarity), "active")
    rows = active.join(pieces, [*_PIECE, "side", "id"]).join(involved, "id")
    joined = stored(connected_components(_linked(rows, sets_of, similarity)), "merged").select(F.col("id").alias("component"), F.col("component").alias("merged"))
    # components found so far move to the merged ones; a large one is split by Spark, as a left join allows
    moved = found.join(joined, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))
    # classes linked for the first time come new
    fresh = joined.join(found.select("component").distinct(), "component", "left_anti")
    return moved.union(fresh.select(F.col("component").alias("id"), F.col("merged").alias("component")))
