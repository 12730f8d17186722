"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: Pieces packed together; shards hold about so many whatever the input, so a task's memory is bounded.
SHARD_PIECES = 20_000


def default_cost(capacity: int) -> float:
    """Cost of a sequence: a fixed share, one unit per place and the quadratic share of attention."""
    return 128 + capacity + capacity * capacity / 65536


class Packer:
    """Best-fit decreasing under a plan: for each permitted size, the size that opens where it would do.

    Pieces come longest first. Each goes to the open bin with the least room that still takes it;
    else a bin opens, of the size that the plan has for the smallest one that takes the piece. At
    the end each bin shrinks to the least size that holds its contents.
    """

    def __init__(self, capacities: tuple[int, ...], plan: tuple[int, ...]):
        self.capacities, self.plan = capacities, plan
        self.rooms: list[int] = []  # distinct rooms of open bins, ascending
        self.bins_with: dict[int, list[int]] = {}
        self.used: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        k = bisect_left(self.rooms, length)
        if k < len(self.rooms):
            room = self.rooms[k]
            same = self.bins_with[room]
            number = same.pop()
            if not same:
                del self.bins_with[room]
                del self.rooms[k]
        else:
            room = self.capacities[self.plan[bisect_left(self.capacities, length)]]
            number = len(self.used)
            self.used.append(0)
        offset = self.used[number]
        self.used[number] += length
        left = room - length
        if left:
            if left not in self.bins_with:
                insort(self.rooms, left)
                self.bins_with[left] = []
            self.bins_with[left].append(number)
        return number, offset

    def size(self, number: int) -> int:
        return self.capacities[bisect_left(self.capacities, self.used[number])]


def plan_cost(lengths: list[int], capacities: tuple[int, ...], plan: tuple[int, ...], cost) -> float:
    """Cost of all bins, shrunk to their contents, of lengths (longest first) packed under a plan."""
    packer = Packer(capacities, plan)
    for n in lengths:
        packer.place(n)
    return sum(cost(packer.size(b)) for b in range(len(packer.used)))


def best_plan(lengths: list[int], capacities: tuple[int, ...], cost) -> tuple[int, ...]:
    """The plan of least cost found for these lengths (longest first), the permitted sizes taken together.

    Plans that open one common size, or the smallest that fits beyond it, come first; then each
    size's choice is tried anew, given all others, until no change of one choice saves anything.
    Every trial packs all lengths. Of equal plans the one with smaller sizes stays.
    """
    sizes = range(len(capacities))
    known: dict[tuple[int, ...], float] = {}

    def tried(plan: tuple[int, ...]) -> tuple[float, tuple[int, ...]]:
        if plan not in known:
            known[plan] = plan_cost(lengths, capacities, plan, cost)
        return known[plan], plan

    best = min(tried(tuple(max(k, least) for k in sizes)) for least in sizes)
    # no piece asks for a choice of a size that none needs
    asked = sorted({bisect_left(capacities, n) for n in set(lengths)})
    while True:
        found = min((tried((*best[1][:k], other, *best[1][k + 1 :])) for k in asked for other in sizes if other >= k), default=best)
        if found[0] >= best[0]:
            return best[1]
        best = found


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length=None, capacities: tuple[int, ...] = CAPACITIES, cost=default_cost, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, capacity, bin_offset, bin_used.

    `length` is a column with the number of tokens of a document; by default the UTF-8 bytes of its
    text, as a byte-level model reads them. A document longer than the largest capacity is cut
    into pieces of that capacity and a rest. Every document has a row: null or empty ones have
    piece 0 of length 0 in no bin (null bin). Pieces are dealt to shards of about shard_pieces by
    a hash, and each shard is planned and packed on its own, which costs at most its last open
    bins. Rows that repeat a document are packed each for itself; columns other than the named
    ones are not read.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    size = F.coalesce(F.col(length) if isinstance(length, str) else length if length is not None else F.octet_length(text), F.lit(0)).cast("long")
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("total"))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / top).cast("int") - 1)
    pieces = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(top), F.col("total") - start).alias("length"))
    n = sized.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("total") / top)))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_pieces))
    # the place in its input partition tells repeated rows apart
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))
    dealt = pieces.where("length > 0").withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    names = ["doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_offset", "bin_used"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(number: int, rows: list[tuple]) -> pa.RecordBatch:
            lengths = [r[3] for r in rows]
            packer = Packer(capacities, best_plan(lengths, capacities, cost))
            placed = [packer.place(n) for n in lengths]
            columns = [
                *[pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                pa.array([(number << 32) | b for b, _ in placed], pa.int64()),
                pa.array([packer.size(b) for b, _ in placed], pa.int64()),
                pa.array([o for _, o in placed], pa.int64()),
                pa.array([packer.used[b] for b, _ in placed], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        shard, rows = None, []
        for batch in batches:
            for *row, number in zip(*(c.to_pylist() for c in batch.columns)):
                if number != shard:
                    if rows:
                        yield packed(shard, rows)
                    shard, rows = number, []
                rows.append(row)
        if rows:
            yield packed(shard, rows)

    out = dealt.select("doc_id", "piece", "start", "length", "shard").mapInArrow(run, "doc_id long, piece int, start long, length long, bin_id long, capacity long, bin_offset long, bin_used long")
    empty = pieces.where("length = 0").select("doc_id", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in names[4:]])
    return out.unionByName(empty)
