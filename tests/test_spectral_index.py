"""Nearest reference spectra: no cell is lost, and the index finds what a full search finds."""

import random

import pytest
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import joins
from luminode.operators.spectral_index import SpectrumIndex, cosine_distance

SPECTRA = "id int, flags array<int>, v array<double>"
REFERENCES = "code string, flags array<int>, ref_v array<double>"


def clustered(draw, centres, n):
    for k in range(n):
        flags, centre = centres[k % len(centres)]
        yield flags, [max(0.0, x + draw.gauss(0, 0.03)) for x in centre]


def test_every_cell_has_a_code(spark):
    cells = spark.createDataFrame([(1, [1], [1.0, 0.0]), (2, [0], [0.0, 1.0]), (3, [1], [0.6, 0.8])], SPECTRA)
    ref = spark.createDataFrame([("b", [1], [1.0, 0.0], 0), ("a", [1], [0.0, 1.0], 1), ("c", [0], [1.0, 1.0], 1)], REFERENCES + ", replicate int")
    got = {(r.id, r.replicate): (r.code, round(r.distance, 6)) for r in joins.nn_classify(cells, ref, S.cosine, "id").collect()}
    assert got == {(1, 0): ("b", 0.0), (1, 1): ("a", 1.0), (2, 0): ("b", 1.0), (2, 1): ("c", 0.292893), (3, 0): ("b", 0.4), (3, 1): ("a", 0.2)}
    assert joins.nn_classify(cells, ref.limit(0), S.cosine, "id").count() == 0


def test_index_equals_full_search_and_reads_less(spark):
    draw = random.Random(4)
    centres = [([k % 2], [draw.random() ** 3 for _ in range(16)]) for k in range(40)]
    references = [(f"c{k % 40:02}", f, v) for k, (f, v) in enumerate(clustered(draw, centres, 1200))]
    references += [("c05", references[5][1], references[5][2]), ("a00", references[7][1], references[7][2]), ("z", [0], [0.0] * 16)]
    cells = [(k, f, v) for k, (f, v) in enumerate(clustered(draw, centres, 400))] + [(900, [0], [0.0] * 16), (901, [1], [0.0] * 16), (902, [7], [1.0] * 16), (903, [0], [0.0] * 15 + [1.0])]
    asked, ref = spark.createDataFrame(cells, SPECTRA), spark.createDataFrame(references, REFERENCES)
    index = SpectrumIndex(ref)
    found = lambda df: {r.id: (r.code, r.distance) for r in df.collect()}
    got, full = found(index.nearest(asked, "id")), found(joins.nn_classify(asked, ref, cosine_distance, "id"))
    assert got == full and len(got) == 404
    assert (got[900], got[901][1], got[902]) == (("z", 0.0), 1.0, ("a00", 1.0))
    # lists are small and few are opened: far fewer comparisons than cells x references of a block
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
    unit = asked.where(F.col("id") < 400).select(F.col("flags").cast("string").alias("block"), F.transform("v", lambda x: x / norm).alias("u"), "id", "v")
    near = index._nearest_pivot(unit, ("id", "v"))
    placed = unit.join(near.select("id", "pivot"), "id").join(index.nearest(asked, "id").select("id", F.acos(1 - F.col("distance")).alias("bound")), "id")
    opened = index._open_lists(placed).select("pivot").union(near.select("pivot"))
    compared = opened.join(index.lists.groupBy("pivot").agg(F.count("*").alias("n")), "pivot").agg(F.sum("n")).first()[0]
    assert compared < 400 * 600 / 3


def test_index_without_references(spark):
    cells = spark.createDataFrame([(1, [1], [1.0, 0.0])], SPECTRA)
    ref = spark.createDataFrame([], REFERENCES)
    (row,) = SpectrumIndex(ref).nearest(cells, "id").collect()
    assert (row.code, row.distance) == (None, pytest.approx(1.0))
