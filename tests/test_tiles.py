"""Nearest cells by trees of squares: as all pairs give them, in as many rounds as density asks for."""

import math
import random

from luminode.operators import joins, tiles
from luminode.operators.tiles import LEAF, CellTree

CELLS, POINTS = "image_id int, cell int, x double, y double", "image_id int, point_id int, px double, py double"


def brute(at, asked, k):
    want = {}
    for image, p, px, py in asked:
        near = sorted((math.hypot(x - px, y - py), c) for i, c, x, y in at if i == image and x is not None)[:k]
        want |= {(p, r): c for r, (_, c) in enumerate(near, 1)}
    return want


def test_dense_clusters_and_far_points(spark):
    draw = random.Random(8)
    at = [(1, i, draw.uniform(0, 1), draw.uniform(0, 1)) for i in range(150)]
    # a cluster a millionth as wide, cells of one place, and a point beside them
    at += [(1, 1000 + i, 0.5 + draw.uniform(0, 1e-6), 0.5 + draw.uniform(0, 1e-6)) for i in range(300)]
    at += [(1, 2000 + i, 0.25, 0.75) for i in range(60)] + [(2, 3000, 1.0, 1.0), (2, 3001, None, 1.0), (2, 3002, float("nan"), 1.0)]
    asked = [(1, i, draw.uniform(-1, 2), draw.uniform(-1, 2)) for i in range(30)] + [(1, 30 + i, 0.5 + draw.uniform(-1e-5, 1e-5), 0.5) for i in range(10)]
    asked += [(1, 50, 0.25, 0.75), (1, 51, 0.26, 0.75), (2, 60, 5.0, 5.0), (3, 70, 0.0, 0.0)]
    want = brute([a for a in at if a[2] is None or a[2] == a[2]], asked, 7)
    tree = CellTree(spark.createDataFrame(at, CELLS))
    got = {(r.point_id, r["rank"]): r.cell for r in tree.nearest(spark.createDataFrame([*asked, (1, 80, None, 0.0)], POINTS), 7).collect()}
    assert got == want
    sizes = [r.n for r in tree.nodes.where("level > 0").collect()]
    assert tree.cells.count() == len(at) - 2 and max(sizes) > LEAF >= min(sizes)


def test_many_small_images_take_no_round(spark):
    draw = random.Random(3)
    at = [(i // 10, i, draw.uniform(0, 9), draw.uniform(0, 9)) for i in range(20000)]
    asked = [(i, i, 4.0, 5.0) for i in range(2000)]
    tree = CellTree(spark.createDataFrame(at, CELLS))
    found = tree.nearest(spark.createDataFrame(asked, POINTS), 3)
    got = {(r.point_id, r["rank"]): r.cell for r in found.where("image_id % 40 = 7").collect()}
    assert tree.rounds == 0 and found.count() == 6000
    assert got == brute([a for a in at if a[0] % 40 == 7], [a for a in asked if a[0] % 40 == 7], 3)


def test_images_of_one_cell_and_of_none(spark):
    cells = spark.createDataFrame([(1, 5, 2.0, 2.0)], CELLS)
    points = spark.createDataFrame([(1, 1, 0.0, 2.0), (2, 2, 0.0, 0.0)], POINTS)
    assert [(r.point_id, r.cell, r.distance) for r in joins.knn_points(points, cells, 4).collect()] == [(1, 5, 2.0)]
    assert joins.knn_points(points, cells.limit(0), 4).count() == 0


def test_crowded_squares_are_dealt_out(spark, monkeypatch):
    draw = random.Random(4)
    at = [(1, i % 2, i, draw.gauss(0, 3), draw.gauss(0, 3)) for i in range(120)] + [(1, 0, 500, 40.0, 40.0)]
    frame = spark.createDataFrame(at, "image_id int, code int, cell int, x double, y double")
    want = {(a[2], b[2]) for a in at for b in at if a[1] == b[1] and a[2] < b[2] and math.hypot(a[3] - b[3], a[4] - b[4]) <= 2.5}
    found = lambda: sorted((r.id_1, r.id_2) for r in joins.pairs_within(frame, 2.5).collect())
    assert found() == sorted(want)
    monkeypatch.setattr(joins, "CROWD", 3)
    assert found() == sorted(want)


def test_rows_of_a_search_do_not_grow_with_its_points(spark, monkeypatch):
    draw = random.Random(5)
    at = [(1, i, draw.uniform(0, 1), draw.uniform(0, 1)) for i in range(40)]
    asked = [(1, i, 0.4 + draw.uniform(0, 1e-3), 0.4) for i in range(1500)]
    tree, write, rows = CellTree(spark.createDataFrame(at, CELLS)), tiles.stored, []

    def counted(df, name):
        out = write(df, name)
        rows.extend([out.count()] if name == "front" else [])
        return out

    monkeypatch.setattr(tiles, "stored", counted)
    assert tree.nearest(spark.createDataFrame(asked, POINTS), 2).count() == 3000
    assert rows and max(rows) < 200
