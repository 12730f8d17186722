"""Nearest cells in the plane by a tree of squares per image: dense squares split, sparse ones do not.

The square around an image's cells is cut into 2 x 2 squares wherever it holds more than LEAF
cells, and so on down. A search goes down the tree for all points at once, those of one square
together: counts of squares alone bound how far the k-th cell of any of them can be, and squares
beyond that bound are left. Each group of points meets a list of the cells of the leaves that
remain, and each point takes its nearest from the list: exact, whatever the density.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luminode.sources.shared import stored

#: Cells of a square that is not split; splits of a side at a time, as bits, and the deepest level.
LEAF, BITS, DEEPEST = 16, 1, 20
#: Squares that are split.
SPLITS = f"n > {LEAF} AND level < {DEEPEST}"


def _finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < 1e300)
    return out


def _levels(rows: DataFrame, image: str) -> DataFrame:
    """A row for every level: the square of that level (gx, gy) that holds the row's square of the deepest level."""
    each = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))))
    up = (DEEPEST - F.col("level")) * BITS
    # shifts of a varying number of bits are divisions by a power of two
    return each.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), up)).cast("long") for c in ("gx", "gy")})


class CellTree:
    """The squares of every image: `nodes` (image, level, gx, gy, n) and the cells of leaves.

    Cells without a finite place are left out. Cells of one place stay together below the deepest level.
    """

    def __init__(self, cells: DataFrame, image: str = "image_id", x: str = "x", y: str = "y"):
        self.image = image
        rows = cells.where(_finite(x, y)).withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
        box = rows.groupBy(image).agg(F.min("__x").alias("x0"), F.min("__y").alias("y0"), F.greatest(F.max("__x") - F.min("__x"), F.max("__y") - F.min("__y")).alias("side"))
        self.boxes = stored(box.withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)), "boxes")
        last = float((1 << (BITS * DEEPEST)) - 1)
        place = lambda c, zero: F.least(F.lit(last), F.floor((F.col(c) - F.col(zero)) / F.col("side") * (last + 1))).cast("long")
        # an image's box is one row: a large image is split by Spark, as the left side of a left join may be
        placed = rows.join(self.boxes, image, "left").withColumns({"gx": place("__x", "x0"), "gy": place("__y", "y0")}).drop("x0", "y0", "side")
        square = [image, "level", "gx", "gy"]
        counts = stored(_levels(placed.select(image, "gx", "gy"), image).groupBy(*square).agg(F.count("*").alias("n")), "squares")
        full = counts.where(f"n > {LEAF}").select(image, (F.col("level") + 1).alias("level"), F.col("gx").alias("px"), F.col("gy").alias("py"))
        parent = {c: F.floor(F.col(g) / (1 << BITS)).cast("long") for c, g in (("px", "gx"), ("py", "gy"))}
        inner = counts.where("level > 0").withColumns(parent).join(full, [image, "level", "px", "py"], "left_semi").select(*square, "n")
        self.nodes = stored(counts.where("level = 0").select(*square, "n").unionByName(inner), "nodes")
        leaves = self.nodes.where(f"n <= {LEAF} OR level = {DEEPEST}").select(*square)
        self.cells = stored(_levels(placed, image).join(leaves, square, "left_semi"), "leaf-cells")

    def _bounds(self, rows: DataFrame) -> DataFrame:
        """near and far: least and greatest distance of a group's points (ax..bx, ay..by) to a square, a trifle loose."""
        size = F.col("side") / F.pow(F.lit(float(1 << BITS)), F.col("level"))
        loose = F.col("side") * 1e-9

        def apart(a: str, b: str, zero: str, g: str) -> tuple[Column, Column]:
            low = F.col(zero) + F.col(g) * size - loose
            high = low + size + 2 * loose
            return F.greatest(low - F.col(b), F.col(a) - high, F.lit(0.0)), F.greatest(F.col(b) - low, high - F.col(a))

        (nx, fx), (ny, fy) = apart("ax", "bx", "x0", "gx"), apart("ay", "by", "y0", "gy")
        return rows.withColumns({"near": F.sqrt(nx * nx + ny * ny), "far": F.sqrt(fx * fx + fy * fy)})

    def _pruned(self, rows: DataFrame, k: int) -> DataFrame:
        """Squares of each group that may hold one of the k nearest cells of a point in it.

        `reach` bounds the k-th cell's distance from any of its points; `open` tells whether the group has a square to split.
        """
        every = Window.partitionBy(self.image, "ql", "qx", "qy")
        upto = every.orderBy("far", "level", "gx", "gy").rowsBetween(Window.unboundedPreceding, 0)
        # what the group above could not need goes before the rows are dealt
        rows = self._bounds(rows).where("near <= reach").withColumn("held", F.sum("n").over(upto))
        rows = rows.withColumn("reach", F.coalesce(F.min(F.when(F.col("held") >= k, F.col("far"))).over(every), F.lit(float("inf"))))
        return rows.where("near <= reach").withColumn("open", F.max(F.expr(SPLITS)).over(every)).drop("held", "near", "far")

    def _fronts(self, placed: DataFrame, k: int) -> list[DataFrame]:
        """For each depth the groups of points that go no deeper, a row per square that may hold cells near to them.

        Points of one square (ql, qx, qy) go down together, bounded by their own box (ax..bx, ay..by); a
        group is parted in 2 x 2 as long as one of its squares is, so its rows do not grow with its points.
        """
        image = self.image

        def groups(level: int) -> DataFrame:
            of = {q: F.shiftright(q, (DEEPEST - level) * BITS) for q in ("qx", "qy")}
            box = [f(p).alias(f"{name}{p[1]}") for p in ("px", "py") for name, f in (("a", F.min), ("b", F.max))]
            return placed.groupBy(image, *[c.alias(q) for q, c in of.items()]).agg(*box).withColumn("ql", F.lit(level))

        child = self.nodes.where("level > 0").select(image, (F.col("level") - 1).alias("level"), *[F.shiftright(g, BITS).alias(g) for g in ("gx", "gy")], F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.col("n").alias("cn"))
        roots = self.nodes.where("level = 0").join(self.boxes, image).withColumn("reach", F.lit(float("inf")))
        start = groups(0).join(roots, image).withColumn("open", F.expr(SPLITS))
        columns = [c for c in start.columns if c != "open"]
        deal = max(placed.sparkSession.sparkContext.defaultParallelism, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.rounds, fronts = 0, [start]
        for level in range(DEEPEST):
            if self.nodes.where(f"level = {level} AND {SPLITS}").isEmpty():
                break
            above = fronts[-1].where("open").drop("ax", "bx", "ay", "by").withColumnsRenamed({"qx": "ux", "qy": "uy"}).drop("ql", "open")
            parts = groups(level + 1).withColumns({u: F.shiftright(q, BITS) for u, q in (("ux", "qx"), ("uy", "qy"))})
            # few rows become many here: they stay dealt to all cores, however small they are
            above, parts = (rows.repartition(deal, image, "ux", "uy") for rows in (above, parts))
            # squares that are too far from the smaller group go first
            met = self._bounds(above.join(parts, [image, "ux", "uy"])).where("near <= reach").select(*columns)
            below = met.where(SPLITS).drop("n").join(child, [image, "level", "gx", "gy"])
            below = below.withColumns({"level": F.col("level") + 1, "gx": F.col("cx"), "gy": F.col("cy"), "n": F.col("cn")}).select(*columns)
            fronts.append(stored(self._pruned(met.where(f"NOT ({SPLITS})").unionByName(below), k), "front"))
            self.rounds += 1
        return [front.where("NOT open") for front in fronts]

    def nearest(self, points: DataFrame, k: int, id: str = "cell") -> DataFrame:
        """points (image, point_id, px, py, ...) with the columns of their k nearest cells, distance and rank; ties by id."""
        image, point = self.image, [self.image, "point_id", "px", "py"]
        asked = points.where(_finite("px", "py")).withColumns({c: F.col(c).cast("double") for c in ("px", "py")})
        if set(points.columns) == set(point):
            asked = asked.distinct()
        # points lie on the cells' grid, continued beyond their box
        end = F.lit(float(1 << 50))
        place = lambda c, zero: F.floor(F.greatest(-end, F.least(end, (F.col(c) - F.col(zero)) / F.col("side") * float(1 << (BITS * DEEPEST))))).cast("long")
        placed = asked.join(self.boxes, image, "left").where("side IS NOT NULL")
        placed = stored(placed.withColumns({"qx": place("px", "x0"), "qy": place("py", "y0")}).drop("x0", "y0", "side"), "points")
        fronts = self._fronts(placed, k)
        group, of = [image, "ql", "qx", "qy"], [c for c in self.cells.columns if c not in (image, "level", "gx", "gy")]
        cells = self.cells
        if self.rounds == DEEPEST:  # of cells of one place the first k by id are enough
            same = Window.partitionBy(image, "level", "gx", "gy", "__x", "__y").orderBy(id)
            cells = cells.withColumn("__first", F.row_number().over(same)).where(F.col("__first") <= k).drop("__first")
        squares = reduce(DataFrame.unionByName, [front.select(*group, "level", "gx", "gy", "reach", "ax", "bx", "ay", "by") for front in fronts])
        dx, dy = (F.greatest(F.col(f"a{c}") - F.col(f"__{c}"), F.col(f"__{c}") - F.col(f"b{c}"), F.lit(0.0)) for c in "xy")
        met = squares.join(cells, [image, "level", "gx", "gy"]).where(F.sqrt(dx * dx + dy * dy) <= F.col("reach"))
        lists = met.groupBy(*group).agg(F.collect_list(F.struct(*of)).alias("__near"))
        # a point is in one group of all depths; the lists are joined to it, so that no row per point and cell is dealt
        levels = placed.withColumn("ql", F.explode(F.sequence(F.lit(0), F.lit(self.rounds)))) if self.rounds else placed.withColumn("ql", F.lit(0))
        levels = levels.withColumns({q: F.expr(f"shiftright({q}, CAST({(DEEPEST * BITS)} - {BITS} * ql AS INT))") for q in ("qx", "qy")})
        found = levels.join(lists, group).select(*asked.columns, F.inline(_first("__near", k, id)))
        return found.select(*asked.columns, *[F.col(f"__cell.{c}").alias(c) for c in of if c not in ("__x", "__y")], "distance", "rank")


def _first(near: str, k: int, id: str) -> Column:
    """Of an array of cells the k nearest to (px, py), with distance and rank, in their order."""

    def distance(c: Column) -> Column:
        dx, dy = c["__x"] - F.col("px"), c["__y"] - F.col("py")
        return F.sqrt(dx * dx + dy * dy)

    # a value that several steps use is bound to a name by a transform of an array of one
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    keyed = F.transform(near, lambda c, i: F.struct(distance(c).alias("distance"), c[id].alias("id"), i.alias("i")))

    def best(all_: Column) -> Column:
        bound = F.element_at(F.sort_array(F.transform(all_, lambda s: s["distance"])), F.least(F.lit(k), F.size(all_)))
        return let(bound, lambda b: F.slice(F.array_sort(F.filter(all_, lambda s: s["distance"] <= b)), 1, k))

    row = lambda s, r: F.struct(F.element_at(near, s["i"] + 1).alias("__cell"), s["distance"].alias("distance"), (r + 1).alias("rank"))
    return F.transform(let(keyed, best), row)
