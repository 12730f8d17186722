"""Closed forms, sketches, covers, walks, stores and keyed streams against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from luminode.operators import cells, joins, models, selection
from luminode.sources import files
from luminode.sources.shared import drop_stored, new_path, stored
from luminode.streaming import incremental


def test_permutation_moments_equal_all_permutations(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]
    codes = ["a", "a", "a", "b", "b", "c"]
    edges = spark.createDataFrame([(0, *e) for p in pairs for e in (p, p[::-1])] + [(1, 1, 2), (1, 2, 1)], "image_id int, label_1 int, label_2 int")
    own = spark.createDataFrame([(0, k, c) for k, c in enumerate(codes, 1)] + [(1, 1, "a"), (1, 2, "b")], "image_id int, label int, code string")
    seen = {(x, y): [] for x in "abc" for y in "abc"}
    for dealt in set(itertools.permutations(codes)):
        count = dict.fromkeys(seen, 0)
        for p in pairs:
            for i, j in (p, p[::-1]):
                count[dealt[i - 1], dealt[j - 1]] += 1
        for k, n in count.items():
            seen[k].append(n)
    got = {(r.code_1, r.code_2): r for r in cells.permutation_moments(edges, own).where("image_id = 0").collect()}
    assert set(got) == set(seen)
    for k, all_counts in seen.items():
        mean = sum(all_counts) / len(all_counts)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in all_counts) / len(all_counts))
        assert (got[k].null_mean, got[k].null_std) == (pytest.approx(mean), pytest.approx(deviation, abs=1e-9))
    assert got["a", "a"].n == 6 and got["a", "b"].n == 1
    two = {(r.code_1, r.code_2): (r.n, r.null_mean, r.null_std, r.z) for r in cells.permutation_moments(edges, own).where("image_id = 1").collect()}
    assert two == {("a", "b"): (1, 1.0, 0.0, None), ("b", "a"): (1, 1.0, 0.0, None), ("a", "a"): (0, 0.0, 0.0, None), ("b", "b"): (0, 0.0, 0.0, None)}


def test_simulated_null_lies_near_the_closed_form(spark):
    draw = random.Random(3)
    own = [(0, k, draw.choice("abc")) for k in range(40)]
    pairs = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(80)}
    edges = spark.createDataFrame([(0, *e) for p in pairs for e in (p, p[::-1])], "image_id int, label_1 int, label_2 int")
    frame = spark.createDataFrame(own, "image_id int, label int, code string")
    exact = {(r.code_1, r.code_2): r for r in cells.permutation_moments(edges, frame).collect()}
    for r in cells.permutation_null(edges, frame, 200).collect():
        e = exact[r.code_1, r.code_2]
        assert abs(r.null_mean - e.null_mean) < 5 * e.null_std / math.sqrt(200) and 0.7 * e.null_std < r.null_std < 1.3 * e.null_std


def test_sketches_keep_to_their_error(spark):
    draw = random.Random(1)
    rows = [(k % 2, k % 7, draw.expovariate(1.0) if k % 2 else float(draw.randrange(50))) for k in range(20000)] + [(2, 0, None), (0, 0, None)]
    df = spark.createDataFrame(rows, "g int, part int, v double").repartition(8)
    got = {r.g: r for r in cells.sketch_quantiles(cells.quantile_sketches(df, ["g", "part"], "v"), ["g"]).collect()}
    assert set(got) == {0, 1} and got[0].n == 10000
    for g, r in got.items():
        values = sorted(v for k, _, v in rows if k == g and v is not None)
        for q, share in ((r.q25, 0.25), (r.q50, 0.5), (r.q75, 0.75)):
            below, upto = sum(v < q for v in values), sum(v <= q for v in values)
            assert below - 100 <= share * len(values) <= upto + 100  # one per cent of the rank
    plan = cells.quantile_sketches(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "partial_kll_sketch_agg_double" in plan


def test_quartiles_within_a_stated_rank(spark):
    df = spark.createDataFrame([(1, k % 3, float((k * 7919) % 5000)) for k in range(5000)], "c int, grp int, n double")
    exact, near = (cells.compare_groups(df, "c", "grp", "n", (0, 1), accuracy=a).first() for a in (None, 100))
    for name in ("q25_1", "q75_1", "q25_2", "q75_2"):
        assert abs(exact[name] - near[name]) <= 5000 / 100 + 5


def smallest_cover(sets, elements):
    for n in range(len(sets) + 1):
        if any(set().union(*c) == elements for c in itertools.combinations(sets.values(), n)):
            return n


def test_covers_without_redundant_choices_and_their_bound(spark):
    draw, data = random.Random(4), []
    for key in range(30):
        for choice in range(7):
            data += [(key, e, choice) for e in draw.sample(range(9), draw.randrange(1, 5))]
    # greedy takes 10 first, then needs 11 and 12, which make 10 redundant
    data += [(99, e, 10) for e in (2, 3, 4, 5)] + [(99, e, 11) for e in (1, 2, 3)] + [(99, e, 12) for e in (4, 5, 6)]
    df = spark.createDataFrame(data + data[:20], "key int, element int, choice int")
    chosen = selection.min_cover(df, "key", "element", "choice", stored)
    kept = selection.without_redundant(df, chosen, "key", "element", "choice", stored)
    bound = {r.key: r.lower_bound for r in selection.cover_bound(df, chosen, "key", "element", "choice").collect()}
    picked = {}
    for r in kept.collect():
        picked.setdefault(r.key, set()).add(r.choice)
    assert picked[99] == {11, 12} and chosen.where("key = 99").count() == 3
    for key in {k for k, _, _ in data}:
        sets = {}
        for k, e, c in data:
            if k == key:
                sets.setdefault(c, set()).add(e)
        elements, mine = set().union(*sets.values()), picked[key]
        assert set().union(*(sets[c] for c in mine)) == elements
        assert all(set().union(*(sets[c] for c in mine - {gone}), set()) != elements for gone in mine)
        assert 1 <= bound[key] <= smallest_cover(sets, elements) <= len(mine)


def test_walks_double(spark, monkeypatch):
    rows = [(f"t{k}", f"t{k - 1}" if k else "t0", {0: "superkingdom", 500: "genus", 999: "species"}.get(k, "no rank")) for k in range(1000)]
    rows += [("r1", "r2", "genus"), ("r2", "r1", "family"), ("d", "gone", "genus")]
    tree = spark.createDataFrame(rows, "taxid string, parent string, rank string")
    rounds = []
    monkeypatch.setattr(joins, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "taxid string")
    got = {r.id: (r.superkingdom, r.genus, r.species) for r in joins.lineage(ids("t999", "t600", "t0", "d", "absent"), tree, ("superkingdom", "genus", "species")).collect()}
    assert got == {"t999": ("t0", "t500", "t999"), "t600": ("t0", "t500", None), "t0": ("t0", None, None), "d": (None, "d", None)}
    assert len(rounds) <= 12
    with pytest.raises(ValueError, match="ring"):
        joins.lineage(ids("r1"), tree, ("genus",))


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    a = files.write_bucketed(rows, "bucketed_a", ["k"], 4, str(tmp_path / "a"))
    b = files.write_bucketed(rows.groupBy("k").agg(F.sum("v").alias("s")), "bucketed_b", ["k"], 4, str(tmp_path / "b"))
    joined = a.join(b.hint("merge"), "k").groupBy("k").agg(F.max("s").alias("s"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.s for r in joined.collect()} == {k: sum(range(k, 4000, 100)) for k in range(100)}
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE {name}")


def test_a_hot_key_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(8000).select(F.when(F.col("id") < 7000, 1).otherwise(F.col("id") % 5).alias("k"), "id")
        files.write_partitioned(rows, str(tmp_path / "p"), ["k"])
        files.write_partitioned(rows, str(tmp_path / "q"), ["k"], ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in "pq":
        sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / name)).where("k = 1").groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 7200 and len(sizes) >= 3 and max(sizes) < 4000


def test_stored_tables_are_dropped(spark):
    df = stored(spark.range(5), "five")
    assert df.count() == 5 and new_path(spark, "never written")
    assert drop_stored(spark) >= 1 and drop_stored(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        df.collect()


def test_group_functions_on_stretches(spark):
    import pandas as pd

    rows = [("a", 1)] * 500 + [("b", k) for k in range(30)] + [(None, 5), (None, 6)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def partial(group):
        assert len(group) <= 60 and list(group.columns) == ["g", "v"]
        seen.add(1)
        return pd.DataFrame({"g": [group["g"].iloc[0]], "total": [group["v"].sum()], "n": [len(group)]})

    def combine(group, last):
        out = pd.DataFrame({"g": [group["g"].iloc[0]], "total": [group["total"].sum()], "n": [group["n"].sum()]})
        return out.assign(mean=out["total"] / out["n"])[["g", "mean"]] if last else out

    got = {r.g: r.mean for r in models.apply_groups(df, ["g"], partial, "g string, mean double", combine, "g string, total long, n long", rows=10).collect()}
    assert got == {"a": 1.0, "b": 14.5, None: 5.5} and seen.value >= 54
    with pytest.raises(ValueError, match="fewer"):
        models.apply_groups(df, ["g"], lambda group: group, "g string, v long", lambda group, last: group, "g string, v long", rows=10)


def brute_diversity(rows):
    out = {}
    for g in {g for g, _ in rows}:
        n = [sum(1 for k, c in rows if k == g and c == x) for x in sorted({c for k, c in rows if k == g and c})]
        total = sum(n)
        if total:
            out[g] = (total, len(n), pytest.approx(-sum(x / total * math.log(x / total) for x in n)), pytest.approx(total * total / sum(x * x for x in n)))
    return out


def test_stream_with_a_state_by_key(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k % 6, draw.choice(["a", "b", "c", None])) for k in range(400)] + [(9, "only")] * 3
    write = lambda part: spark.createDataFrame(part, "g int, c string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = lambda df: {r.g: (r.n, r.richness, r.shannon, r.inverse_simpson) for r in incremental.last_of(df, ["g"]).collect()}
    write(rows[:200])
    write(rows[200:])
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    first = incremental.diversity_by_key(spark, path, ["g"], "c", folder, files_per_batch=1)
    assert found(first) == brute_diversity(rows) and first.select("batch").distinct().count() == 2
    # started again, it reads the new files only, and writes the keys they hold
    more = [(2, "new"), (2, "a"), (7, "a")]
    write(more)
    again = incremental.diversity_by_key(spark, path, ["g"], "c", folder)
    assert found(again) == brute_diversity(rows + more)
    assert {r.g for r in again.where("batch = 2").collect()} == {2, 7}


def test_idle_keys_lose_their_state(spark, tmp_path):
    folder = str(tmp_path / "state")
    for g, day in ((1, "01"), (2, "20"), (2, "25"), (1, "26"), (2, "26")):
        spark.createDataFrame([(g, "x"), (g, "y")], "g int, c string").withColumn("t", F.lit(f"2024-01-{day} 12:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = incremental.diversity_by_key(spark, str(tmp_path / "in"), ["g"], "c", folder, "t", "5 days")
    last = {r.g: r.n for r in incremental.last_of(changes, ["g"]).collect()}
    assert last == {1: 2, 2: 6}  # key 1 was idle for more than five days and starts anew
    with pytest.raises(ValueError):
        incremental.diversity_by_key(spark, str(tmp_path / "in"), ["g"], "c", new_path(spark, "x"), "t")
