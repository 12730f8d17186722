"""Running values with one key that holds all rows: cut into parts, and equal to windows over the key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from luminode.operators import scans, selection

ROWS = "k int, id int, t long, flag int, v double"


@pytest.fixture(scope="module")
def rows(spark):
    # a table as small as this one would be put into one part
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield _rows(spark)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows(spark):
    draw = random.Random(6)
    data = [(1 if i < 3000 else draw.choice([2, 3, None]), i, draw.randrange(2000), int(draw.random() < 0.004), draw.random()) for i in range(3300)]
    return spark.createDataFrame(data, ROWS).withColumn("t", F.timestamp_seconds("t")).repartition(4)


def test_one_key_lies_in_many_parts(rows):
    parts = scans.ranged(rows, ["k"], [F.col("t"), F.col("id")])
    assert parts.where("k = 1").select(scans.PART).distinct().count() >= 3


def test_nearest_flagged_row(rows):
    data = [(r.k, r.id, r.t, r.flag) for r in rows.collect()]
    got = {r.id: r.nearest_id for r in scans.nearest_flagged(rows, "k", "t", "flag", "id").collect()}
    assert len(got) == len(data)
    for k, i, t, _ in random.Random(1).sample(data, 200):
        flagged = [(abs((u - t).total_seconds()), u, j) for q, j, u, f in data if f and q == k]
        best = min(flagged, default=None)
        if best and (best[1], best[2]) != (t, i):
            # a flagged row of the same moment stands before or after by its id
            same = sorted(j for d, u, j in flagged if d == 0)
            best_id = (max([j for j in same if j <= i], default=None) or min(same)) if same else best[2]
            if not same and best[1] < t:
                best_id = max(j for d, u, j in flagged if u == best[1])
            assert got[i] == best_id
        elif not flagged:
            assert got[i] is None


def test_running_sums_equal_windows(rows):
    order = [F.col("t").desc(), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: (r.i, r.s) for r in rows.withColumns({"i": F.row_number().over(Window.partitionBy("k").orderBy(*order)), "s": F.sum("v").over(w)}).collect()}
    got = {r.id: (r.i, r.s) for r in scans.running(rows, ["k"], order, "i", {"s": "v"}).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(got[i][1] == pytest.approx(s) for i, (_, s) in want.items())


def test_smoothing_in_blocks(rows, monkeypatch):
    order = [F.asc("t"), F.asc("id")]
    whole = {r.id: r.smoothed for r in selection.smooth(rows, ["k"], order, "v").collect()}
    halo = scans.with_halo
    monkeypatch.setattr(selection, "with_halo", lambda *a: halo(*a, block=100))
    cut = {r.id: r.smoothed for r in selection.smooth(rows, ["k"], order, "v").collect()}
    assert cut == whole and len(cut) == 3300


def test_fallbacks(spark):
    data = [("a", 1, 5, True), ("a", 2, 4, False), ("a", 3, 3, True), ("b", 4, 2, None), ("b", 5, 1, False), (None, 6, 1, True), (None, 7, 0, False)]
    df = spark.createDataFrame(data, "taxon string, id int, bin int, ok boolean")
    order = [F.asc("bin")]
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(selection.all_specific(df, F.col("ok"), "taxon", order)) == [1, 3, 5, 6]
    assert ids(selection.top_n(df, F.col("ok"), "taxon", order, 1)) == [3, 5, 6]
    got = selection.with_fallback(df, F.col("ok"), "taxon", order, order, "bin", ("bins", "single"))
    assert sorted((r.id, r.selection_method) for r in got.collect()) == [(1, "bins"), (3, "bins"), (5, "single"), (6, "bins")]
    assert set(got.columns) == {"taxon", "id", "bin", "ok", "selection_method"}
