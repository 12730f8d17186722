"""An exact index of reference spectra: lists around pivots, pruned by the triangle inequality of angles.

References of one block (equal flags) are kept in lists, each around one of some sqrt(n) pivots. A
cell first meets the list of its nearest pivot; the best angle found there closes every list whose
pivot is farther away than that angle and the list's radius together. What stays open is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.sources.shared import stored

#: Pivots over all blocks: what every task holds is bounded by so many spectra.
MOST_PIVOTS = 4096
#: Angles closer than this count as equal when lists are closed; distances are compared exactly later.
SLACK = 1e-4
#: References of a list that one task holds, cells of a list that one task is given, and those compared at once.
HELD, GIVEN, BLOCK = 4096, 50_000, 500


def cosine_distance(a, b):
    """Cosine distance to nine places: ties do not hang on the last bit."""
    return F.round(S.cosine(a, b), 9)


def _angles(batch: pa.RecordBatch, block: int, u: int, pivots: dict):
    """(rows, first pivot, angles to all pivots) of each block of a batch that has pivots."""
    names = batch.column(block).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(names.dictionary.to_pylist()):
        if name in pivots:
            mine = np.flatnonzero(codes == k)
            first, directions = pivots[name]
            vectors = batch.column(u).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
            yield mine, first, np.arccos(np.clip(vectors @ directions.T, -1, 1))


class SpectrumIndex:
    """References by block and pivot; nearest() gives each cell its nearest one, as a full search would.

    reference: code, a spectrum `v` and a block column. Equal spectra of a block are one entry with the
    smallest code. Cells of a block without references have the smallest code of all at distance 1,
    as have flags that differ. Zero spectra are at distance 1 from others and 0 from each other.
    """

    def __init__(self, reference: DataFrame, v: str = "ref_v", block: str = "flags", code: str = "code"):
        norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
        rows = reference.select(F.col(block).cast("string").alias("block"), F.col(v).alias("v"), F.col(code).alias("code")).groupBy("block", "v").agg(F.min("code").alias("code"))
        rows = stored(rows.withColumns({"norm": norm, "draw": F.xxhash64("block", "v")}), "references")
        self.least = rows.agg(F.min("code")).first()[0]
        # a row per block, however many references: codes of cells that no list can tell apart
        self.blocks = rows.groupBy("block").agg(F.min("code").alias("any_code"), F.min(F.when(F.col("norm") == 0, F.col("code"))).alias("zero_code"))
        self.code_type = reference.schema[code].dataType
        unit = rows.where("norm > 0").withColumn("u", F.transform("v", lambda x: x / F.col("norm")))
        sizes = unit.groupBy("block").agg(F.count("*").alias("n"), F.min("draw").alias("least_draw"))
        share = max(1.0, (sizes.agg(F.sum(F.ceil(F.sqrt("n")))).first()[0] or 0) / (MOST_PIVOTS / 2))
        step = F.ceil(F.sqrt("n") * share).cast("long")
        # the reference of the least draw makes sure that each block has a pivot
        drawn = unit.join(sizes, "block").where((F.pmod(F.col("draw"), step) == 0) | (F.col("draw") == F.col("least_draw"))).select("block", "draw", "u")
        held: dict[str, list] = {}
        if drawn.count() > MOST_PIVOTS:
            raise ValueError(f"more than {MOST_PIVOTS} blocks of references")
        for r in drawn.orderBy("draw").collect():
            held.setdefault(r.block, []).append(r.u)
        first, self.pivots = 0, {}
        for name, vectors in sorted(held.items()):
            self.pivots[name] = (first, np.array(vectors))
            first += len(vectors)
        self.lists = stored(self._nearest_pivot(unit.select("block", "u", "v", "code"), ("v", "code")), "lists")
        # a row per pivot
        self.radius, self.sizes = np.zeros(first), np.zeros(first, np.int64)
        for r in self.lists.groupBy("pivot").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
            self.radius[r.pivot], self.sizes[r.pivot] = r.r, r.n

    def _nearest_pivot(self, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """rows (block, u, ...) with pivot and angle; rows of blocks without pivots are left out."""
        taken, pivots = rows.select("block", "u", *keep), self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mine, first, angles in _angles(batch, 0, 1, pivots):
                    best = angles.argmin(axis=1)
                    part = batch.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array((first + best).astype(np.int32)), pa.array(angles[np.arange(len(mine)), best])], [*keep, "pivot", "angle"])

        fields = ", ".join(f"`{c}` {taken.schema[c].dataType.simpleString()}" for c in keep)
        return taken.mapInArrow(run, f"{fields}, pivot int, angle double")

    def _open_lists(self, rows: DataFrame) -> DataFrame:
        """(id, v, pivot): the lists, but for the nearest pivot's, that may hold something as near as `bound`."""
        pivots, radius = self.pivots, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound, nearest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
                for mine, first, angles in _angles(batch, 0, 1, pivots):
                    reach = radius[first : first + angles.shape[1]]
                    is_open = angles - reach[None] <= bound[mine, None] + SLACK
                    is_open[np.arange(len(mine)), nearest[mine] - first] = False
                    row, pivot = np.nonzero(is_open)
                    part = batch.take(pa.array(mine[row]))
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array((first + pivot).astype(np.int32))], ["id", "v", "pivot"])

        taken = rows.select("block", "u", "id", "v", "bound", "pivot")
        return taken.mapInArrow(run, f"id {taken.schema['id'].dataType.simpleString()}, v array<double>, pivot int")

    def _compared(self, asked: DataFrame) -> DataFrame:
        """(id, distance, code): the nearest reference of each list that a cell (id, v, pivot) asks for.

        Long lists are cut, cells of a much asked list are dealt to several tasks, each of which is
        given the list; a task holds one stretch of a list at a time.
        """
        asked_for = {r.pivot: r["count"] for r in asked.groupBy("pivot").count().collect()}  # a row per pivot
        plan = [(k, -(-int(self.sizes[k]) // HELD), -(-n // GIVEN)) for k, n in asked_for.items()]
        kind = self.code_type.simpleString()
        plan = F.broadcast(asked.sparkSession.createDataFrame(plan, "pivot int, parts int, salts int"))
        all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        given = asked.join(plan, "pivot").select("pivot", all_of("parts").alias("part"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "id", "v", F.lit(None).cast(kind).alias("code"))
        held = self.lists.join(plan, "pivot").select("pivot", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), all_of("salts").alias("salt"), F.lit(0).alias("side"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), "v", "code")
        key = ["pivot", "part", "salt"]
        rows = held.unionByName(given).repartition(*key).sortWithinPartitions(*key, "side", "code")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, vectors, codes = None, [], []
            for batch in batches:
                marks = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
                edges = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if a == b:
                        continue
                    own = tuple(marks[a, :3].tolist())
                    spectra = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                    spectra = spectra / np.sqrt((spectra * spectra).sum(axis=1))[:, None]
                    if marks[a, 3] == 0:
                        if own != at:
                            at, vectors, codes = own, [], []
                        vectors.append(spectra)
                        codes.append(batch.column(6).slice(a, b - a))
                        continue
                    if own != at:
                        continue
                    # codes ascend: of equally near references the first is the one
                    vectors, codes = [np.concatenate(vectors)], [pa.concat_arrays(codes)]
                    for k in range(0, b - a, BLOCK):
                        distance = np.round(1 - spectra[k : k + BLOCK] @ vectors[0].T, 9) + 0.0
                        best = distance.argmin(axis=1)
                        least = distance[np.arange(len(best)), best]
                        yield pa.RecordBatch.from_arrays([batch.column(4).slice(a + k, len(best)), pa.array(least), codes[0].take(pa.array(best))], ["id", "distance", "code"])

        return rows.mapInArrow(compare, f"id {asked.schema['id'].dataType.simpleString()}, distance double, code {kind}")

    def nearest(self, cells: DataFrame, id: str, v: str = "v", block: str = "flags") -> DataFrame:
        """(id, code, distance) of every cell."""
        norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
        rows = cells.select(F.col(id).alias("id"), F.col(v).cast("array<double>").alias("v"), F.col(block).cast("string").alias("block")).withColumn("norm", norm)
        unit = rows.where("norm > 0").withColumn("u", F.transform("v", lambda x: x / F.col("norm")))
        placed = self._nearest_pivot(unit.select("block", "u", F.col("block").alias("own"), "id", "v"), ("own", "id", "v"))
        placed = stored(placed.select(F.col("own").alias("block"), "id", "v", "pivot"), "placed")
        best = F.min(F.struct("distance", "code")).alias("b")
        near = stored(self._compared(placed.select("id", "v", "pivot")).groupBy("id").agg(best), "near")
        bound = placed.join(near, "id").withColumns({"bound": F.acos(F.greatest(F.lit(-1.0), 1 - F.col("b.distance"))), "norm": norm})
        opened = stored(self._open_lists(bound.withColumn("u", F.transform("v", lambda x: x / F.col("norm")))), "opened")
        wider = self._compared(opened).groupBy("id").agg(best)
        # what no list can give: a block's zero spectra, and the default of blocks without references
        missing = F.lit(self.least).cast(self.code_type)
        rest = rows.select("id", "block", "norm").join(self.blocks, "block", "left")
        lone = F.when(F.col("any_code").isNull(), F.struct(F.lit(1.0).alias("distance"), missing.alias("code")))
        zero = F.when(F.col("norm") == 0, F.when(F.col("zero_code").isNotNull(), F.struct(F.lit(0.0).alias("distance"), F.col("zero_code").alias("code"))).otherwise(F.struct(F.lit(1.0).alias("distance"), F.col("any_code").alias("code"))))
        zeros = F.when(F.col("zero_code").isNotNull(), F.struct(F.lit(1.0).alias("distance"), F.col("zero_code").alias("code")))
        every = near.select("id", "b").unionByName(wider).unionByName(rest.select("id", F.coalesce(lone, zero, zeros).alias("b")))
        return every.groupBy("id").agg(F.min("b").alias("b")).select(F.col("id").alias(id), F.col("b.code").alias("code"), F.col("b.distance").alias("distance"))
