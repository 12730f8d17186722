"""Hand-made cases for rules that tables seldom reach."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode import plans
from luminode.operators import cells, joins, models, selection, summaries
from luminode.sources import files
from luminode.sources.shared import stored
from luminode.streaming import incremental


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "q, s, compat, exact",
    [("ACGT", "ACGT", 4, 4), ("ACGTA", "TCGTA", 4, 4), ("ACGTACGT", "ACGAACGT", 4, 4), ("ACGTA", "ACGTT", 4, 4), ("AACCA", "TACCT", 4, 3)],
)
def test_max_homology(spark, q, s, compat, exact):
    assert one(spark, S.max_homology("q", "s"), q=q, s=s) == compat
    assert one(spark, S.max_homology("q", "s", "exact"), q=q, s=s) == exact


def test_ring_pairs(spark):
    assert one(spark, S.ring_pairs("c"), c="1000000") == []
    assert one(spark, S.ring_pairs("c"), c="1010000") == ["1010000"]
    assert one(spark, S.ring_pairs("c"), c="1010001") == ["1010000", "0010001", "1000001"]


def test_copies_round_half_to_even(spark):
    assert [one(spark, S.copies("b"), b=b) for b in (1, 2, 3, 4, 6)] == [15, 15, 5, 4, 2]


def test_band_cosine_without_active_band(spark):
    v = [0.0] * 63
    assert one(spark, S.band_cosine("a", "b", "f", "g"), a=v, b=v, f=[0, 0, 0, 0], g=[0, 0, 0, 0]) == 1.0
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=v, b=v) == 0.0


def test_probe_summary_without_hits_above(spark):
    rows = [("p", 5, 6, 50.0, 1.0, 10.0, 40.0, 3, True, True, False), ("q", 20, 20, 100.0, 1.0, 40.0, 60.0, 9, True, True, True)]
    hits = spark.createDataFrame(rows, "probe_id string, mch int, length int, qcovhsp double, evalue double, bitscore double, tm double, gc int, target_hit boolean, full_hit boolean, full_match boolean")
    got = {r.probe_id: r for r in summaries.probe_summary(hits, spark.createDataFrame([("p", 2), ("q", 2)], "probe_id string, abundance long"), 18).collect()}
    assert (got["p"].on_target_rate, got["p"].off_target_max_mch, got["p"].on_target_full_match) == (0.0, 5, 0.0)
    assert (got["q"].on_target_rate, got["q"].off_target_min_evalue, got["q"].on_target_full_match) == (1.0, 100.0, 0.5)


def test_smoothing_keeps_cubics():
    w = selection.smoothing_weights(20)
    assert math.isclose(sum(w), 1.0)
    assert abs(sum(k * k * x for k, x in zip(range(-20, 21), w))) < 1e-9


def test_t_tail(spark):
    # two-sided tails known from tables
    rows = spark.createDataFrame([(2.228, 10), (1.96, 100000), (0.0, 5)], "t double, n int")
    got = [r.p for r in rows.select(cells.t_tail(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([0.05, 0.05, 1.0], abs=1e-3)


def test_cluster_links_behind_unrelated_leaders(spark):
    # all shared buckets of a near pair hold a smaller id: windows of the first that are not similar enough themselves
    draw, seqs = random.Random(5), {}
    letters = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    for group in range(3):
        first = letters(1200)
        for w in range(8):
            at = 150 * w
            gone = {x % 1200 for x in range(at, at + 300)}
            seqs[100 * group + w] = "".join(c for k, c in enumerate(first) if k not in gone)
        other = list(first)
        for at in range(70, 1200, 150):
            other[at] = {"A": "C", "C": "G", "G": "T", "T": "A"}[other[at]]
        seqs[100 * group + 90], seqs[100 * group + 91] = first, "".join(other)
    seqs |= {1000: "ACGT", 1001: "ACGT", 1002: "ACG", 1003: seqs[91], 1004: None, 1005: letters(400)}
    sets = {i: {s[k : k + 12] for k in range(len(s) - 11)} for i, s in seqs.items() if s and len(s) > 11}
    want = {i: i for i in seqs} | {1001: 1000}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = {m: low if c == high else c for m, c in want.items()}
    assert (want[91], want[191], want[291], want[1003]) == (90, 190, 290, 90)
    got = {r.id: r.cluster for r in models.cluster(spark.createDataFrame(list(seqs.items()), "id int, seq string"), "id", "seq", 0.8).collect()}
    assert got == want
    named = spark.createDataFrame([(f"m{i:04}", s) for i, s in seqs.items()], "id string, seq string")
    assert {r.id: r.cluster for r in models.cluster(named, "id", "seq", 0.8).collect()} == {f"m{i:04}": f"m{c:04}" for i, c in want.items()}


SF = "/root/testdata/sf0.001"


def test_fasta_titles_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">m1 a->b >c\nAC\nGT\n>m2\nGG\n\n>m3 empty\n")
    got = {r.molecule_id: r.seq for r in files.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"m1": "ACGT", "m2": "GG", "m3": ""}


@pytest.mark.parametrize("kind", sorted(files.HITS))
def test_hits_of_all_kinds(spark, tmp_path, kind):
    fields = files.schema_of(files.HITS[kind]).fields
    line = "\t".join("7" if f.dataType.typeName() != "string" else f"{f.name}_x" for f in fields)
    (tmp_path / "a.tsv").write_text(line + "\n")
    (tmp_path / "b.tsv").write_text("")
    (row,) = files.read_hits(spark, str(tmp_path), kind).collect()
    assert len(row) == len(fields) == {"molecule": 14, "probe": 16, "probe_slim": 15}[kind] and row[0] == f"{fields[0].name}_x" and row.bitscore == 7.0


def test_walks_and_covers_do_not_stop_early(spark):
    tree = spark.createDataFrame([(f"t{k}", f"t{k - 1}" if k else None, "species" if k == 5 else "phylum") for k in range(6)], "taxid string, parent string, rank string")
    ids = spark.createDataFrame([("t5",)], "taxid string")
    assert joins.lineage(ids, tree, ("species",)).first().species == "t5"
    with pytest.raises(ValueError):
        joins.lineage(ids, tree, ("species",), depth=3).collect()
    cover = spark.createDataFrame([(1, e, e) for e in range(5)], "key int, element int, choice int")
    assert selection.min_cover(cover, "key", "element", "choice", stored).count() == 5
    with pytest.raises(RuntimeError):
        selection.min_cover(cover, "key", "element", "choice", stored, max_rounds=2)


def test_nearest_cells_against_all_pairs(spark):
    draw = random.Random(2)
    at = [(i % 3, i, draw.choice([draw.gauss(0, 1), draw.uniform(-500, 500)]), draw.gauss(0, 30)) for i in range(300)] + [(5, 900, 0.0, 0.0)]
    asked = [(i % 3, i, draw.uniform(-900, 900), draw.uniform(-90, 90)) for i in range(60)] + [(5, 99, 1e4, 0.0), (7, 98, 0.0, 0.0)]
    cells_, points = spark.createDataFrame(at, "image_id int, cell int, x double, y double"), spark.createDataFrame(asked, "image_id int, point_id int, px double, py double")
    got = {(r.point_id, r["rank"]): r.cell for r in joins.knn_points(points, cells_, 7).collect()}
    want = {}
    for image, p, px, py in asked:
        near = sorted((math.hypot(x - px, y - py), c) for i, c, x, y in at if i == image)[:7]
        want |= {(p, k): c for k, (_, c) in enumerate(near, 1)}
    assert got == want
    assert joins.knn_points(points, cells_.limit(0), 7).count() == 0


def test_smoothing_fits_edges(spark):
    cubic = lambda k: 0.5 + 0.3 * ((k - 30) / 30) ** 3 - 0.1 * ((k - 30) / 30)
    rows = spark.createDataFrame([(1, k, cubic(k)) for k in range(61)] + [(2, k, 0.5) for k in range(40)], "g int, k int, v double")
    got = selection.smooth(rows, ["g"], [F.asc("k")], "v").collect()
    assert all(r.smoothed == pytest.approx(cubic(r.k)) for r in got if r.g == 1)
    assert all(r.smoothed is None for r in got if r.g == 2)


def test_melting_temperature_by_hand(spark):
    def by_hand(seq):
        ends = sum(x in "AT" for x in (seq[0], seq[-1]))
        h, s = (sum(S.STEPS[seq[k : k + 2]][i] for k in range(len(seq) - 1)) + ends * S.END_AT[i] + (2 - ends) * S.END_GC[i] for i in (0, 1))
        kelvin, ion, gc = 1000 * h / (s + S.GAS_CONSTANT * math.log(74.5e-9)), math.log(0.39), sum(x in "GC" for x in seq) / len(seq)
        return 1 / (1 / kelvin + (4.29 * gc - 3.95) * 1e-5 * ion + 9.40e-6 * ion * ion) - 273.15

    draw = random.Random(9)
    seqs = ["".join(draw.choice("ACGT") for _ in range(n)) for n in (2, 3, 20, 400)]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([*seqs, "A", "", None, "ACGNT", "ACGé"])], "k int, seq string").repartition(1)
    got = {r.k: r.tm for r in rows.select("k", S.melting_temperature("seq").alias("tm")).collect()}
    assert [got[k] for k in range(4)] == pytest.approx([by_hand(s) for s in seqs])
    assert [got[k] for k in range(4, 9)] == [None] * 5


def test_bootstrap_draws_differ_by_key(spark):
    rows = spark.createDataFrame([(g, k, float(k)) for g in (1, 2) for k in range(30)], "g int, k int, v double")
    got = {r.g: r for r in cells.bootstrap_mean(rows, ["g"], "v", "k", 50).collect()}
    assert got[1].mean != got[2].mean and all(abs(r.mean - 14.5) < 1.5 and r.q25 <= r.mean <= r.q75 + 1 for r in got.values())


@pytest.mark.parametrize("kind", ["forest", "margin"])
def test_learned_classes_of_unseen_rows(spark, kind):
    draw = random.Random(1)
    centres = [[draw.random() for _ in range(12)] for _ in range(5)]
    rows = [(k, k % 5, [max(0.0, x + draw.gauss(0, 0.08)) for x in centres[k % 5]]) for k in range(300)] + [(None, 0, centres[0])]
    got = models.cross_classify(spark.createDataFrame(rows, "id int, label int, v array<double>"), "id", "label", "v", kind).collect()
    assert len(got) == 301 and sum(r.label == r.prediction for r in got) / 301 > 0.95


def test_learned_classes(spark):
    # the table's labels do not depend on its vectors: unseen rows are right by chance only
    for name in ("u04_forest", "u04_linear_margin"):
        rows = plans.QUERIES[name](spark, SF).collect()
        assert len(rows) == len({r.vec_id for r in rows}) == 500 and {r.prediction for r in rows} <= {float(r.label) for r in rows}
    for r in plans.QUERIES["u06_class_probability"](spark, SF).collect():
        assert 0 < r.mean_probability <= 1 and r.n > 0


def test_stream_classifies_as_the_batch_does(spark):
    got = {r.vec_id: (r.code, r.distance) for r in plans.QUERIES["s01_classify_stream"](spark, SF).collect()}
    batch = {r.vec_id: r.code for r in plans.QUERIES["c16_nearest_spectrum"](spark, SF).where("replicate = 0").collect()}
    assert {k: v[0] for k, v in got.items()} == batch


def test_streams_in_several_batches(spark, tmp_path):
    days = {"a": ("2024-01-10", 3), "b": ("2024-01-10", 2), "c": ("2024-01-01", 5), "d": ("2024-01-09", 1)}
    for name, (day, n) in days.items():
        rows = spark.createDataFrame([(k % 2, "xyz"[k % 3], f"{day} 12:00:00") for k in range(n)], "g int, c string, t string")
        rows.coalesce(1).select("g", "c", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in" / name))
    path = str(tmp_path / "in")
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    counts = rows.groupBy("g", "c").agg(F.count("*").alias("n"))
    whole = str(tmp_path / "whole")
    rows.repartition(4).write.parquet(whole)
    got = incremental.run_abundance(spark, whole, ["g"], "c", files_per_batch=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counts.collect()))
    each = incremental.run_diversity(spark, whole, ["g"], "c", files_per_batch=1)
    last = max(r.batch for r in each.collect())
    assert last >= 2
    shannon = lambda df: {r.g: round(r.shannon, 9) for r in df.collect()}
    assert shannon(each.where(F.col("batch") == last)) == shannon(summaries.diversity(counts, ["g"]))


def test_late_rows_find_their_window_closed(spark, tmp_path):
    for day in ("2024-01-10", "2024-01-09", "2024-01-01"):
        row = spark.createDataFrame([("x", f"{day} 12:00:00")], "c string, t string")
        row.select("c", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    counts = lambda **how: {str(r.window_start)[:10]: r.n for r in incremental.run_abundance(spark, str(tmp_path / "in"), [], "c", "t", **how).collect()}
    assert counts(files_per_batch=1) == {"2024-01-10": 1, "2024-01-09": 1}
    assert counts(files_per_batch=1, delay="30 days") == counts() == {"2024-01-10": 1, "2024-01-09": 1, "2024-01-01": 1}


def test_probability_profile(spark):
    rows = spark.createDataFrame([(0.01, 0.5), (0.03, 0.7), (0.035, 0.9), (None, 0.4)], "area double, max_probability double")
    got = {r.bin: (r.n, r.mean_probability) for r in models.probability_profile(rows, "area", 0.02).collect()}
    assert got == {0: (1, 0.5), 1: (2, pytest.approx(0.8)), None: (1, 0.4)}


def test_best_probes(spark):
    got = plans.best_probes(spark, SF).collect()
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    methods = {}
    for r in got:
        methods.setdefault(r.taxon, []).append(r.selection_method)
        assert 56 <= r.tm <= 64 and r.gc >= 9 and 0 <= r.on_target_rate <= 1 and r.taxon in texts
    # bins of an item differ; the fallback is one probe
    assert len({(r.taxon, r.bin) for r in got}) == len(got)
    assert all(m == ["single"] or set(m) == {"bins"} for m in methods.values())


@pytest.mark.parametrize("method", ["top_n", "all_specific", "single_best"])
def test_designs_choose_by_their_method(spark, method):
    found = plans.best_probes(spark, SF, probe_selection_method=method, tpn=2, min_tm=58.0, max_tm=61.0).collect()
    taxa = {}
    for r in found:
        taxa.setdefault(r.taxon, []).append(r.selection_method)
        assert 58 <= r.tm <= 61 and 18 <= int(r.probe_id.split("_")[2]) <= 23
    assert taxa and all(m == ["single"] or (set(m) == {method} and (method == "all_specific" or len(m) <= {"top_n": 2, "single_best": 1}[method])) for m in taxa.values())


def test_unknown_method_of_a_design(spark):
    with pytest.raises(ValueError):
        plans.best_probes(spark, SF, probe_selection_method="other")
