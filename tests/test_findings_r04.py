"""Findings of the fourth round: what failed on larger tables, on small ones that have the same fault."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from luminode import plans
from luminode.operators import align, cells, greedy, models, similar, whole
from luminode.plans import base


def test_flat_field_rounds_as_its_sql(spark, tmp_path):
    """A quotient just below a half of the seventh place, which scaling by 10^7 makes a half."""
    values = {0: 791.0, 9: 62.0, 10: 26.25, 11: 0.0}  # the brightest place, and the three frames of another
    events = spark.createDataFrame([(k, 1, v) for k, v in values.items()], "event_id long, user_id long, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    answer = con.execute(plans.ORACLE_SQL["b23_flat_field"])
    order = [c[0] for c in answer.description]
    want = sorted((*r[:3], list(r[3])) for r in answer.fetchall())
    got = plans.QUERIES["b23_flat_field"](spark, str(tmp_path)).select(*order)
    assert sorted(map(tuple, got.collect())) == want
    assert [w[0] for *_, w in want].count(111.8303633) == 1


def test_average_of_frames_is_the_same_in_any_order(spark):
    """0.1 + 0.2 + 0.3 differs in its last bit from 0.3 + 0.2 + 0.1; frames are added in their order."""
    frames = [(0, 0.1), (1, 0.2), (2, 0.3), (3, None)]
    for order in (frames, frames[::-1], frames[1:] + frames[:1]):
        rows = [(k, 0, 0, v) for k, v in order] + [(0, 1, 0, 1.0), (0, 2, 0, None)]
        df = spark.createDataFrame(rows, "k int, x int, y int, v double").coalesce(1)
        got = {r.x: r.calibration for r in cells.average_frames(df, frame="k").collect()}
        assert got == {0: (0.1 + 0.2 + 0.3) / 3, 1: 1.0, 2: None}


def _letters(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("ACGT") for _ in range(n))


def _changed(draw: random.Random, seq: str, changes: int, gaps: int) -> str:
    out = list(seq)
    for _ in range(changes):
        out[draw.randrange(len(out))] = draw.choice("ACGT")
    for _ in range(gaps):
        at, n = draw.randrange(len(out)), draw.randrange(1, 9)
        out[at : at + n] = _letters(draw, n) if draw.random() < 0.5 else ""
        out[at:at] = _letters(draw, n) if draw.random() < 0.3 else ""
    return "".join(out)


@pytest.mark.parametrize("keep", [whole.KEEP, 500])
def test_whole_alignment_is_the_plain_program_at_any_size(monkeypatch, keep):
    """Anchors, and stretches beyond a million cells taken as replaced, gave other alignments to long sequences than to short ones."""
    monkeypatch.setattr(whole, "KEEP", keep)
    draw = random.Random(8)
    pairs = [(_letters(draw, 1100), _letters(draw, 1100)), ("", ""), ("", "ACG"), ("AéC日", "éC日日"), ("ACGT" * 50, "ACGT" * 41)]
    for _ in range(60):
        a = _letters(draw, draw.randrange(1, 260))
        at = draw.randrange(len(a))
        pairs += [(a, _changed(draw, a, 6, 4)), (a, a[:at] + a[at + draw.randrange(120) :]), (a, _letters(draw, draw.randrange(1, 40)))]
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            want = align.align([x], [y], local=False)[0]
            assert greedy.align_whole(x, y) == (want.query, want.target)


def test_consensus_is_the_vote_of_plain_alignments(spark):
    """Only signs that differ from the centroid's are counted; the vote is that of all signs of all members."""
    draw, members, centres, want = random.Random(9), [], {}, {}
    for cluster in range(12):
        truth = _letters(draw, draw.choice([30, 150, 400]))
        group = [_changed(draw, truth, 5, 3) for _ in range(draw.randrange(1, 7))]
        group += group[: draw.randrange(3)]
        centres[cluster] = group[0]
        members += [(cluster, seq) for seq in group]
        votes = {}
        for seq in group:
            pair, at, inserted = align.align([group[0]], [seq], local=False)[0], -1, 0
            for x, y in zip(pair.query, pair.target):
                at, inserted = (at, inserted + 1) if x == "-" else (at + 1, 0)
                votes.setdefault((at, inserted), Counter())[y] += 1
        best = {k: min((-n, sign == "-", sign) for sign, n in v.items()) for k, v in votes.items()}
        kept = [b[2] for k, b in sorted(best.items()) if k[1] == 0 or -2 * b[0] > len(group)]
        want[cluster] = (len(group), "".join(kept).replace("-", ""))
    members += [(0, None), (50, "ACG")]  # no vote; a cluster without a centroid
    df = spark.createDataFrame(members, "cluster long, seq string")
    got = greedy.consensus_aligned(df, spark.createDataFrame(list(centres.items()), "cluster long, seq string"))
    assert {r.cluster: (r.members, r.consensus) for r in got.collect()} == want


def test_consensus_of_all_clusters(spark):
    """Clusters of one member are their sequences; null ones are none."""
    seqs = spark.createDataFrame([(1, "ACGTT"), (2, "ACGTT"), (3, "ACCTT"), (4, "GG"), (5, None), (6, "")], "id long, seq string")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)], "id long, centroid long")
    got = {r.cluster: (r.members, r.consensus) for r in greedy.cluster_consensus(seqs, clusters, "id", "seq").collect()}
    assert got == {1: (3, "ACGTT"), 4: (1, "GG"), 6: (1, "")}


def test_sequences_on_bytes_are_those_of_the_expression(spark):
    """Every character, nulls and empty texts, in batches with and without them; also where lower case makes a letter of another script one of a-z."""
    every = [c for c in map(chr, range(1, 0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(every[k : k + 5000]) for k in range(0, len(every), 5000)] + [None, "", "The Quick, brown", "\u212a\u0130iK", None, "123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    want = {r.doc_id: r.seq for r in docs.select("doc_id", base.dna("text").alias("seq")).collect()}
    assert {r.doc_id: r.seq for r in base.sequences(docs).collect()} == want
    assert len(want) == len(texts) and want[len(texts) - 3] == "GAAG"  # "kiik"


def test_signatures_do_not_depend_on_the_company(spark, monkeypatch):
    """Small sets are signed together, in few calls of numpy; the marks are those of each set alone."""
    draw = random.Random(4)
    texts = [_letters(draw, draw.choice([5, 13, 40, 200, 1500])) for _ in range(300)] + ["", None]
    sets_of = models.kmer_sets(12)
    calls, real = [], similar.superminhash
    monkeypatch.setattr(similar, "superminhash", lambda sets: calls.append(len(sets)) or real(sets))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    held = {}

    class Rows:
        """Runs the function of mapInArrow here."""

        def select(self, *_):
            return self

        def mapInArrow(self, function, schema):
            held["rows"] = [row for out in function(iter([batch])) for row in out.to_pylist()]

    similar.signatures(Rows(), sets_of)
    assert len(held["rows"]) == len(texts) and len(calls) <= 6  # a call for every 64 rows before
    for row, own in zip(held["rows"], sets_of(pa.array(texts, pa.string()))):
        assert row["n"] == len(own) and (row["signature"] is None) == (row["n"] == 0)
        if len(own):
            assert row["signature"] == similar.short_signatures(real([own]))[0].tobytes()


def test_swaps_give_the_permutation_of_slots():
    """Each layer's slot, told from the swaps before, is that of a table of all slots."""
    draw = np.random.default_rng(6)
    for size in (1, 7, 60):
        elements = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
        want = np.full(similar.SLOTS, np.uint64(2**64 - 1))
        for e in elements:
            places = list(range(similar.SLOTS))
            for layer in range(similar.SLOTS):
                drawn = int(similar.mix(np.array([(int(e) + int(similar._A) * (layer + 1)) % 2**64], np.uint64))[0])
                at = layer + ((drawn >> 32) * (similar.SLOTS - layer) >> 32)
                places[layer], places[at] = places[at], places[layer]
                want[places[layer]] = min(int(want[places[layer]]), (layer << 32) | (drawn & 0xFFFFFFFF))
        assert (similar.superminhash([elements])[0] == want).all()
