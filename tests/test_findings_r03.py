"""Findings of the third round: what failed on larger tables, on small ones that have the same fault."""

import random
import tracemalloc
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from luminode import plans
from luminode.functions import scalars
from luminode.operators import cells, greedy, joins, models, probes, seeds, selection


def _as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, str(folder))
    answer = con.execute(plans.ORACLE_SQL[name])
    order = [c[0] for c in answer.description]
    return sorted(map(tuple, got.select(*order).collect())), sorted(answer.fetchall())


def test_mean_spectrum_far_down_an_image(spark, tmp_path):
    """At row 500,000 a mean of the third channel has more digits than a double rounded to nine places tells."""
    rows = random.Random(1)
    events = [(61_500_000 + k, rows.randrange(1500), rows.randrange(60_000) / 100) for k in range(4000)]
    df = spark.createDataFrame(events, "event_id long, user_id long, value double").repartition(4)
    got, want = _as_sql(spark, tmp_path, "d22_mean_spectrum", events=df)
    assert got == want and len(got) > 100
    of = {}
    for k, user, value in events:
        y = k // 123
        of.setdefault((k % 3, user % 12 + 1 + 12 * (y // 8)), []).append(Fraction(round(100 * value), 100) * (y + 2))
    for image, label, spectrum in got:
        exact = of[image, label]
        assert spectrum[2] == float(sum(exact) / len(exact)) or abs(spectrum[2] / float(sum(exact) / len(exact)) - 1) < 3e-16


def test_sigma_gate_decides_values_on_the_limit(spark):
    """A value exactly a deviation from the mean is within, and not above, in whatever order rows are summed."""
    rows, groups = random.Random(2), []
    while len(groups) < 60:
        values = [rows.randrange(8) for _ in range(rows.choice([3, 6, 7, 11, 12]))]
        n, total, square = len(values), sum(values), sum(v * v for v in values)
        on = [v for v in values if (n * v - total) ** 2 == n * square - total * total]
        low = [v for v in values if n * v < total and (n - 1) * (n * v - total) ** 2 == n * (n * square - total * total)]
        if (on or low) and len(set(values)) > 2:
            groups.append(values * 97)
    df = spark.createDataFrame([(g, v, v / 4) for g, values in enumerate(groups) for v in values], "g int, v int, w double").repartition(5)
    df = df.withColumn("w", F.col("w").cast("decimal(9,2)"))
    for column in ("v", "w"):
        for mode in ("within", "above"):
            kept = {r.g: r.n for r in cells.sigma_gate(df, "g", [column], mode).groupBy("g").agg(F.count("*").alias("n")).collect()}
            for g, values in enumerate(groups):
                n, total, square = len(values), sum(values), sum(v * v for v in values)
                spread = n * square - total * total
                if mode == "within":
                    want = sum((n * v - total) ** 2 <= spread for v in values)
                else:
                    want = sum(n * v > total or (n - 1) * (n * v - total) ** 2 < n * spread for v in values)
                assert kept.get(g, 0) == want, (column, mode, values)


def _chain(letters: random.Random, members: int) -> list[str]:
    """Sequences that each differ from the one before in another stretch: linked one after another, each with a few only."""
    now, out = [letters.choice("ACGT") for _ in range(600)], []
    for k in range(members):
        at = k * 41 % 540
        now[at : at + 20] = [letters.choice("ACGT") for _ in range(20)]
        out.append("".join(now))
    return out


@pytest.mark.parametrize("local", [512, 6])
def test_greedy_clusters_of_a_long_chain(spark, monkeypatch, local):
    """Where each sequence waits for the one before, rounds were as many as centroids; now a part is decided in one task."""
    monkeypatch.setattr(greedy, "LOCAL", local)
    letters = random.Random(3)
    texts = _chain(letters, 45)
    seqs = dict(enumerate(texts + texts[:3], 1))
    sets = dict(zip(seqs, map(set, map(lambda x: x.tolist(), models.kmer_sets(12)(pa.array(list(seqs.values())))))))
    want, centres = {}, []
    for k in sorted(seqs, key=lambda k: (-len(seqs[k]), k)):
        want[k] = next((c for c in centres if len(sets[k] & sets[c]) >= 0.8 * len(sets[k] | sets[c])), k)
        if want[k] == k:
            centres.append(k)
    assert len(centres) > 10
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    rounds = {"max_rounds": 2} if local > 50 else {}
    assert {r.id: r.centroid for r in greedy.greedy_clusters(df, "id", "seq", 0.8, **rounds).collect()} == want


def test_small_groups_share_calls_of_the_users_function(spark):
    """Groups that cross batches stay whole, and calls are far fewer than groups."""
    calls = spark.sparkContext.accumulator(0)

    def summarise(pdf):
        calls.add(1)
        return pdf.groupby(["a", "b"], as_index=False, dropna=False).agg(n=("v", "size"), total=("v", "sum"))

    df = spark.range(40_000).select((F.col("id") % 701).alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("b"), F.col("id").alias("v")).where("a > 0 OR v % 5 = 0")
    got = models.apply_groups(df, ["a", "b"], summarise, "a long, b string, n long, total long", together=True).collect()
    want = df.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len(got) == 2103
    assert calls.value < 100


def test_flanks_of_all_windows_of_a_long_sequence(spark):
    """A million letters hold 50,000 windows: a row that carried the whole sequence would make 50 GB of them."""
    letters = random.Random(5)
    seqs = {1: "".join(letters.choices("ACGT", k=1_000_000)), 2: "ACGT" * 11, 3: "ACG", 4: None, 5: "".join(letters.choices("ACGT", k=40))}
    df = spark.createDataFrame(list(seqs.items()), "id int, seq string")
    for length, size in ((20, 3), (4, 9)):
        want = set()
        for k, s in seqs.items():
            if length == 4 and k == 1:
                continue
            for at in range(0, len(s or "") - length + 1, length):
                left, right = s[max(at - size, 0) : at], s[at + length : at + length + size]
                want.add((k, left, right, left + s[at : at + length][::-1] + right))
        got = list(map(tuple, probes.window_flanks(df.where("id > 1") if length == 4 else df, "id", "seq", length, size).collect()))
        assert set(got) == want and len(got) == len(want)


def test_step_sums_of_long_texts_take_little_memory():
    """A batch of 20 million letters took some 50 bytes a letter in numbers."""
    letters = random.Random(6)
    texts = ["".join(letters.choices("ACGTN" if k % 7 == 0 else "ACGT", k=letters.choice([0, 1, 2, 40, 3000]))) for k in range(300)]
    small = pa.array([*texts, None])
    assert scalars.step_sums_of(1000)(small).equals(scalars.step_sums_of(1 << 40)(small))
    assert len(scalars.step_sums_of()(small.slice(0, 0))) == 0
    batch = pa.array(["ACGTTGCAAC" * 200] * 10_000)
    peaks = []
    for run in (scalars.step_sums_of(), scalars.step_sums_of(1 << 40)):
        tracemalloc.start()
        run(batch)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    print(peaks)
    assert peaks[0] < 100 < 500 < peaks[1]


def test_a_row_function_meets_long_texts_in_stretches(spark):
    """A batch of 40 MB: the user's function holds some megabytes of series, and the rows are the same."""
    texts = pa.array([f"{k}" + "GATTACA" * 14_300 for k in range(400)] + [None, "", "GC"])
    seen = []

    def count(seq):
        seen.append(len(seq))
        return seq.str.count("[GC]")

    run = models.in_stretches(count, pa.int64())
    tracemalloc.start()
    out = run(texts)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [2 * 14_300] * 400 + [None, 0, 2] and sum(seen) == 403
    assert held < 15_000_000 and max(seen) <= 43 and run(texts.slice(0, 0)).to_pylist() == []
    rows = spark.createDataFrame([(1, "GATT", 2), (2, None, None), (3, "", 5)], "id int, seq string, k int")
    got = models.apply_rows(rows, "n", "long", lambda seq, k: seq.str.count("[GC]") + k, "seq", "k").select("id", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, None), (3, 5)]


def test_cover_quality_joins_once(spark, monkeypatch):
    """The three steps of e08_cover_quality read stored pairs, not the join of three tables again."""
    plan, bound = [], selection.cover_bound
    monkeypatch.setattr(selection, "cover_bound", lambda cover, *rest: plan.append(cover._jdf.queryExecution().optimizedPlan().toString()) or bound(cover, *rest))
    assert plans.QUERIES["e08_cover_quality"](spark, "/root/testdata/sf0.001").count() == 25
    assert "Join" not in plan[0] and "Aggregate" not in plan[0]


def test_margins_are_fitted_side_by_side_on_few_partitions(spark, monkeypatch):
    """Margins take some 50 jobs a class: one after another, each with a task for every part of the table, they took most of the time."""
    seen, plain = [], models.OneVsRest

    class Watched(plain):
        def _fit(self, dataset):
            seen.append((self.getParallelism(), dataset.rdd.getNumPartitions()))
            return super()._fit(dataset)

    draw = random.Random(7)
    rows = spark.createDataFrame([(k % 3, [draw.random() + (k % 3 == j) / 2 for j in range(4)]) for k in range(90)], "label int, v array<double>").repartition(8)
    monkeypatch.setattr(models, "OneVsRest", Watched)
    monkeypatch.setattr(models, "FIT_ROWS", 40)
    found = models.train(rows, "label", "v", "margin")
    assert len(seen) == 1 and seen[0][0] >= 3 and seen[0][1] == 3
    ready = rows.select(F.col("label").cast("double").alias("label"), models.array_to_vector("v").alias("features"))
    for a, b in zip(found.models, plain(classifier=models.LinearSVC(maxIter=10, regParam=0.01)).fit(ready).models):
        assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), abs=1e-9)
        assert a.intercept == pytest.approx(b.intercept, abs=1e-9)


def _seed_hits_by_hand(probe_of, target_of, k):
    out, other = [], str.maketrans("ACGTN", "TGCAN")
    for p, own in probe_of.items():
        for strand, q in (("+", own), ("-", own and own.translate(other)[::-1])):
            for m, t in target_of.items():
                starts = {j - i for i in range(len(q or "") - k + 1) for j in range(len(t or "") - k + 1) if q[i : i + k] == t[j : j + k]} if m is not None and p is not None else ()
                for d in starts:
                    pairs = [(q[i], t[i + d]) for i in range(len(q)) if 0 <= i + d < len(t)]
                    miss = [i for i, (a, b) in enumerate(pairs) if a != b]
                    gaps = [miss[0], *(b - a for a, b in zip(miss, miss[1:])), len(pairs) - 1 - miss[-1]] if miss else [len(pairs)]
                    run = max(map(len, "".join("x" if a == b else " " for a, b in pairs).split(" ")))
                    out.append((p, strand, m, max(d, 0) + 1, len(pairs), max(gaps), run))
    return out


@pytest.mark.parametrize("longest", [23, 90])
def test_seed_hits_read_each_sequence_once(spark, tmp_path, monkeypatch, longest):
    """Every hit fetched its whole molecule and walked to its place; what a short probe reaches now comes with its seed."""
    monkeypatch.setattr(seeds, "STRETCH", 500)
    draw = random.Random(8)
    text = lambda n, letters="ACGT": "".join(draw.choices(letters, k=n))
    probes_ = {f"p{k}": text(draw.randrange(5, longest)) for k in range(30)} | {"n": None, "e": "", "x": "é" + text(20) + "日", None: "ACGTACGTACGT"}
    targets = {k: text(draw.choice([0, 3, 40, 700])) for k in range(40)} | {50: None, 51: "ÿ" * 30 + probes_["x"] + "\U0001f600", None: "ACGTACGTACGT"}
    for k in range(25):  # whole, cut and changed probes inside and at the ends of molecules
        own = list(probes_[f"p{k}"])
        if k % 3:
            own[draw.randrange(len(own))] = draw.choice("ACGTN")
        targets[100 + k] = text(draw.choice([0, 60])) + "".join(own)[: draw.choice([9, None])] + text(draw.choice([0, 60]))
    spark.createDataFrame(list(targets.items()), "molecule_id long, seq string").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = spark.createDataFrame(list(probes_.items()), "probe_id string, seq string")
    found = joins.seed_hits(rows, spark.read.parquet(str(tmp_path / "t")), 6)
    got = list(map(tuple, found.select("probe_id", "strand", "molecule_id", "molecule_start", "length", "mch", "run").collect()))
    assert len(got) > 100 and sorted(got) == sorted(_seed_hits_by_hand(probes_, targets, 6))
    reads = found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert longest > joins.NEAR or reads == 1


def test_seed_hits_of_no_probe(spark):
    some = spark.createDataFrame([("a", "ACGTACGTACGT")], "id string, seq string")
    for probes_, targets in ((some.limit(0), some), (some, some.limit(0))):
        assert joins.seed_hits(probes_.withColumnRenamed("id", "probe_id"), targets.withColumnRenamed("id", "molecule_id"), 6).count() == 0


def test_clusters_make_each_text_once(spark):
    """Texts were made anew for signatures, for links and twice for the few short ones; short ones still share the smallest id."""
    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return {0: None, 1: "", 2: "ACGT", 3: "GATTACA" * 9 + "C" * 30, 4: "GATTACA" * 9 + "C" * 31, 5: "TTGCA" * 5 + "A" * (k // 6)}[k % 6]

    rows = spark.range(60).repartition(3).withColumn("seq", F.udf(text, "string")("id"))
    got = {r.id: r.cluster for r in models.cluster(rows, "id", "seq", 0.9, k=6).where("id % 6 < 5").collect()}
    assert got == {k: [k, 1, 2, 3, 3][k % 6] for k in range(60) if k % 6 < 5}
    assert made.value == 60


def test_kmer_sets_are_sorted_and_distinct():
    draw = random.Random(9)
    texts = ["".join(draw.choices("ACGT", k=n)) for n in (0, 5, 6, 7, 500, 9000)] + ["A" * 100, None, "é" * 3 + "ACGTACGT"]
    for text, own in zip(texts, models.kmer_sets(6)(pa.array(texts))):
        assert len(own) == len({text[k : k + 6] for k in range(len(text) - 5)} if text else ())
        assert (own[1:] > own[:-1]).all()
