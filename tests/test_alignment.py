"""Gapped hits, greedy clusters and consensus against plain dynamic programs and sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import align, greedy, hits

FLIP = str.maketrans("ACGT", "TGCA")


def letters(draw, n):
    return "".join(draw.choice("ACGT") for _ in range(n))


def changed(draw, seq, subs=0, gaps=0):
    s = list(seq)
    for _ in range(subs):
        k = draw.randrange(len(s))
        s[k] = draw.choice([c for c in "ACGT" if c != s[k]])
    for _ in range(gaps):
        k = draw.randrange(5, len(s) - 5)
        s[k : k + draw.choice([0, 1])] = draw.choice(["A", ""])
    return "".join(s)


def plain_score(q, t, local, match=1, mismatch=-3, opening=5, extend=2):
    """Three-table affine program, cell by cell."""
    low = float("-inf")
    H, E, G = ({} for _ in range(3))
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            E[i, j] = max(E[i - 1, j], H[i - 1, j] - opening) - extend if i else low
            G[i, j] = max(G[i, j - 1], H[i, j - 1] - opening) - extend if j else low
            diagonal = H[i - 1, j - 1] + (match if q[i - 1] == t[j - 1] else mismatch) if i and j else (0 if i == j == 0 else low)
            H[i, j] = max(diagonal, E[i, j], G[i, j], 0 if local else low)
    return max(H.values()) if local else H[len(q), len(t)]


def rescored(a, match=1, mismatch=-3, opening=5, extend=2):
    score, open_q, open_t = 0, False, False
    for x, y in zip(a.query, a.target):
        if x == "-":
            score -= extend + (0 if open_q else opening)
        elif y == "-":
            score -= extend + (0 if open_t else opening)
        else:
            score += match if x == y else mismatch
        open_q, open_t = x == "-", y == "-"
    return score


@pytest.mark.parametrize("local", [True, False])
def test_alignment_equals_plain_program(local):
    draw = random.Random(1)
    pairs = [("", "ACGT"), ("A", ""), ("", ""), ("ACGT", "ACGT")]
    for _ in range(60):
        q = letters(draw, draw.randrange(1, 40))
        t = letters(draw, draw.randrange(12)) + changed(draw, q + "ACGTACGTACGT", draw.randrange(4), draw.randrange(3)) + letters(draw, draw.randrange(12))
        pairs.append((q, t))
    got = align.align([q for q, _ in pairs], [t for _, t in pairs], local)
    for (q, t), a in zip(pairs, got):
        want = plain_score(q, t, local)
        if a is None:
            assert local and want == 0
            continue
        assert a.score == want == rescored(a)
        assert a.query.replace("-", "") == q[a.query_start : a.query_end] and a.target.replace("-", "") == t[a.target_start : a.target_end]
        assert local or (a.query_start, a.query_end, a.target_start, a.target_end) == (0, len(q), 0, len(t))


def test_gapped_hits_equal_full_program(spark, monkeypatch):
    monkeypatch.setattr(hits, "SPREAD", 3)  # frequent seeds are dealt to several tasks
    draw = random.Random(7)
    probes = {f"p{k}": letters(draw, 60) for k in range(4)}
    targets, planted = {}, []
    for k in range(12):
        name, strand = f"p{k % 4}", "+-"[k % 2]
        piece = probes[name] if strand == "+" else probes[name].translate(FLIP)[::-1]
        targets[k] = letters(draw, 80 + k) + changed(draw, piece, k % 3, int(k > 3)) + letters(draw, 50)
        planted.append((name, strand, k))
    targets |= {20: letters(draw, 300), 21: "", 22: None, 23: probes["p0"][5:45] + letters(draw, 30)}
    frame = lambda rows, name, kind: spark.createDataFrame(list(rows.items()), f"{name} {kind}, seq string")
    found = hits.gapped_hits(frame(probes | {"none": None}, "probe_id", "string"), frame(targets, "molecule_id", "int"), k=9, window=3, least=20).collect()
    best = {}
    for r in found:
        best[r.probe_id, r.strand, r.molecule_id] = max(best.get((r.probe_id, r.strand, r.molecule_id), 0), r.score)
        q = probes[r.probe_id] if r.strand == "+" else probes[r.probe_id].translate(FLIP)[::-1]
        assert r.qseq.replace("-", "") == q[r.probe_start - 1 : r.probe_end] and r.sseq.replace("-", "") == targets[r.molecule_id][r.molecule_start - 1 : r.molecule_end]
        assert r.length == len(r.qseq) and r.matches + r.mismatch + r.qseq.count("-") + r.sseq.count("-") == r.length
        assert r.gapopen == sum(c == "-" and p != "-" for s in (r.qseq, r.sseq) for p, c in zip("x" + s, s)) and r.evalue < 1
    for name, q in probes.items():
        for strand in "+-":
            for m, t in targets.items():
                want = plain_score(q if strand == "+" else q.translate(FLIP)[::-1], t or "", True)
                assert best.get((name, strand, m), 0) == (want if want >= 20 else 0), (name, strand, m)
    assert {(n, s, m) for n, s, m in planted} <= set(best)
    assert any("-" in r.qseq + r.sseq for r in found)  # hits with a gap, which ungapped search breaks in two


def test_seeds_of_a_stretch_do_not_move(spark):
    draw = random.Random(2)
    core = letters(draw, 40)
    df = spark.createDataFrame([(1, core), (2, letters(draw, 33) + core), (3, "ACG"), (4, None)], "id int, seq string")
    got = {}
    for r in hits.seeds(df, "id", "seq", 8, 5).collect():
        got.setdefault(r.id, {})[r.i] = r.seed
    assert set(got) == {1, 2}
    inner = {i: s for i, s in got[1].items() if 4 <= i <= 28}
    assert inner and all(got[2][i + 33] == s for i, s in inner.items())
    places = sorted(got[2])
    assert max(b - a for a, b in zip(places, places[1:])) <= 5


def sequential(seqs, k, similarity):
    sets = {i: {s[a : a + k] for a in range(len(s) - k + 1)} for i, s in seqs.items() if s and len(s) >= k}
    centroids, out = [], {}
    for i in sorted(sets, key=lambda i: (-len(seqs[i]), i)):
        near = [c for c in centroids if len(sets[i] & sets[c]) >= similarity * len(sets[i] | sets[c])]
        out[i] = near[0] if near else i
        if not near:
            centroids.append(i)
    return out, sets


def test_greedy_clusters_equal_the_sequential_rule(spark):
    draw, seqs = random.Random(12), {}
    for family in range(5):
        # chains of windows: neighbours are similar, ends are not, so order decides who is a centroid
        base = letters(draw, 1500)
        for w in range(14):
            at = draw.randrange(0, 300)
            seqs[100 * family + w] = changed(draw, base[at : at + 1000 + draw.randrange(60)], draw.randrange(4))
    seqs |= {900: seqs[3], 901: seqs[3], 902: "ACG", 903: "ACG", 904: None, 905: "", 906: letters(draw, 500)}
    want, sets = sequential(seqs, 12, 0.8)
    want |= {902: 902, 903: 902, 904: 904, 905: 905}
    got = {r.id: r.centroid for r in greedy.greedy_clusters(spark.createDataFrame(list(seqs.items()), "id int, seq string"), "id", "seq", 0.8).collect()}
    assert got == want
    assert 10 < len(set(want.values())) < len(want) - 10
    for i, c in got.items():
        if i in sets:
            assert len(sets[i] & sets[c]) >= 0.8 * len(sets[i] | sets[c])
    named = spark.createDataFrame([(f"m{i:04}", s) for i, s in seqs.items()], "id string, seq string")
    assert {r.id: r.centroid for r in greedy.greedy_clusters(named, "id", "seq", 0.8).collect()} == {f"m{i:04}": f"m{c:04}" for i, c in want.items()}
    assert greedy.greedy_clusters(named.limit(0), "id", "seq", 0.8).count() == 0


def test_whole_alignment_by_anchors():
    draw = random.Random(5)
    a = letters(draw, 3000)
    b = changed(draw, a, 40, 12)
    x, y = greedy.align_whole(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    assert sum(p == q for p, q in zip(x, y)) > 2900
    assert greedy.align_whole("", "AC") == ("--", "AC") and greedy.align_whole("AC", "") == ("AC", "--") and greedy.align_whole("", "") == ("", "")
    repeat = "ACGTTGCA" * 40
    x, y = greedy.align_whole(repeat, repeat[:100] + repeat[108:])
    assert x.replace("-", "") == repeat and len(x) == len(y)


def test_consensus_of_members_of_unequal_length(spark):
    draw = random.Random(3)
    truth = {"a": letters(draw, 400), "b": letters(draw, 90)}
    members = []
    for name, seq in truth.items():
        for n in range(9):
            members.append((name, changed(draw, seq, 6, 2)))
    # the centroid of a lacks ten letters that all others have
    centre = {"a": truth["a"][:200] + truth["a"][210:], "b": truth["b"], "c": "ACGT"}
    members += [(name, seq) for name, seq in centre.items()] + [("c", None), ("c", "AGT"), ("c", "ACGGT")]
    got = {r.cluster: (r.members, r.consensus) for r in greedy.consensus_aligned(spark.createDataFrame(members, "cluster string, seq string"), spark.createDataFrame(list(centre.items()), "cluster string, seq string")).collect()}
    assert got == {"a": (10, truth["a"]), "b": (10, truth["b"]), "c": (3, "ACGT")}
