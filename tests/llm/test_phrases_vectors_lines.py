"""Phrases, centroids and repeated lines against brute force and SQL."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from luminode.llm import bloom, centroids, collocations, linededup, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_centroids", "op13_line_dedup"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    answer = con.execute(queries.ORACLE_SQL[name])
    order = [c[0] for c in answer.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(answer.fetchall())


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def brute_phrases(docs, max_words, least, share, top):
    count, left, right, total = defaultdict(Counter), Counter(), Counter(), Counter()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    p = tuple(words[i : i + k])
                    count[lang][p] += 1
                    left[lang, p] += i > 0
                    right[lang, p] += i + k < len(words)
    out = {}
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], left[lang, p], right[lang, p]))
        for rank, (score, a, phrase, l, r, before, after) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, total[lang], -score, before, after)
    return out


@pytest.mark.parametrize("max_words, top", [(3, 30), (4, 1000), (2, 1000)])
def test_collocations_against_brute_force(spark, max_words, top):
    draw = random.Random(max_words)
    vocabulary = ["a", "B", "é", "ÀB", "dd", "ee-f", "x y", "1", "𝕎", "long" * 30]
    docs = [(None, "en"), ("", "en"), ("...\n\t ,", None), ("one", "one"), ("a b " * 3000, "en"), ("a a a a a a a a a a a a a a", "ties")]
    for n in range(120):
        words = [draw.choice(vocabulary[: 3 + n % 8]) + draw.choice(["", "", "", "", ".", ",", "\n", "\t", "  "]) for _ in range(draw.randrange(60))]
        docs.append((" ".join(words), draw.choice(["en", "de", None])))
    docs += docs[20:40]
    df = spark.createDataFrame(docs, "text string, lang string").withColumns({"phrase": F.lit("clash"), "n": F.lit(1), "words": F.lit("x")}).repartition(3)
    want = brute_phrases(docs, max_words, 10, 50, top)
    index = collocations.build_index(df, "text", "lang", max_words, shard_words=700)
    assert index.where("lang = 'en'").count() >= 3  # shards are summed
    whole = collocations.build_index
    collocations.build_index = lambda *a: whole(*a, shard_words=700)
    try:
        got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score, r.n_left, r.n_right) for r in collocations.collocations(df, max_words=max_words, top=top).collect()}
    finally:
        collocations.build_index = whole
    assert got == want and len(want) > 20
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("text IS NULL OR text = ''")).count() == 0


def test_index_finds_every_phrase_of_a_shard():
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcde") + draw.choice(["", "", "."]) for _ in range(200)) for _ in range(5)]
    shard = collocations._Shard()
    shard.add(pa.array(texts))
    batch = shard.index("en", 5)
    index = collocations.Index(batch.column(2).flatten(), batch.column(3)[0].as_buffer(), batch.column(4)[0].as_buffer())
    allowed = np.ones(len(index.words) + 1, bool)
    want = Counter()
    for t in texts:
        for piece in t.split("."):
            w = piece.split()
            want.update(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for turns in ([True] * 4, [False] * 4, [True, False, False, True]):
        got = Counter()
        for now in index.slices(allowed):
            for right in turns:
                now = index.extend(now, right, allowed)
            for row in zip(*(index.words.take(pa.array(w - 1)).to_pylist() for w in now.words), now.size.tolist()):
                got[row[:-1]] += row[-1]
        assert got == want


def test_bloom_filters_miss_nothing():
    keys = np.random.default_rng(5).integers(0, 2**63, 20_000).astype(np.uint64)
    a, b = (np.zeros(bloom.bits_for(20_000) // 8, np.uint8) for _ in range(2))
    bloom.mark(a, keys[:10_000])
    assert bloom.holds(a, keys[:10_000]).all() and bloom.holds(a, keys[10_000:]).mean() < 0.02
    bloom.mark(b, keys[9_000:])
    both = bloom.holds(a & b, keys)
    assert both[9_000:10_000].all() and both.mean() < 0.1
    assert bloom.bits_for(10**15) == bloom.MOST_BITS


def brute_lines(docs, least_chars=20, least_documents=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < least_documents or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    draw = random.Random(9)
    common = ["the quick brown fox jumps over", "  THE quick brown fox jumps over \r", "ÄÖÜ ist ein sehr langes Wort", "äöü ist ein sehr langes wort", "exactly twenty chars", "exactly 19 charact.", "é" * 20, "x" * 5000]
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "  \t\x0b"), (None, "\n".join(common)), (None, common[0])]
    for i in range(10, 70):
        lines = [draw.choice([*common, "", " ", f"a line of its own, number {i} {draw.random()}"]) for _ in range(draw.randrange(12))]
        docs.append((i, "\n".join(lines)))
    docs += [(30, common[0] + "\n" + common[4]), docs[20], docs[20], (99, ("repeated in one document only, often\n" * 50) + "end\n"), (100, "a b\n" * 40000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_lines(docs)
    plain = linededup.dedup_lines(df.repartition(5))
    assert sorted(map(tuple, plain.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == want
    assert sum(r[3] for r in want) > 50
    # other columns stay as they are; those of the result's names give way
    more = df.select(F.lit("n").alias("N_Lines"), F.col("text"), F.lit(7).alias("__gone"), F.lit(8).alias("__id"), F.lit(None).cast("string").alias("key"), "doc_id", F.array(F.lit(1)).alias("gone"))
    out = linededup.dedup_lines(more)
    assert out.columns == ["text", "__gone", "__id", "key", "doc_id", "gone", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == want
    assert out.where("__gone = 7 AND __id = 8 AND key IS NULL AND gone[0] = 1").count() == len(docs)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def brute_centroids(vectors, clusters, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(float(x)) for x in v)]
    centres = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, q in kept:
            members[near(q)[1]].append(q)
        centres = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(centres)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for i, c, d in found), key=repr)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>", "array<decimal(12,4)>"])
def test_centroids_against_brute_force(spark, kind):
    draw = random.Random(2)
    wide = [1.0, 5000.0] if kind != "array<decimal(12,4)>" else [1.0, 900.0]
    for scale_of in wide:  # one table over the whole range; only the values that occur
        vectors = [(i, [round(draw.gauss(i % 4, 1.0), 3) * scale_of for _ in range(6)]) for i in range(80)]
        vectors += [(3, vectors[7][1]), (None, vectors[8][1]), *vectors[:5], (200, [0.5] * 5), (201, [0.5] * 7), (202, None), (203, []), (204, [None, *[0.1] * 5])]
        if kind != "array<decimal(12,4)>":
            vectors += [(205, [float("nan"), *[0.1] * 5]), (206, [float("inf")] * 6)]
        df = spark.createDataFrame(vectors, "vec_id int, embedding array<double>").withColumns({"embedding": F.col("embedding").cast(kind), "cluster": F.lit("x"), "q": F.lit(1)})
        given = [(r.vec_id, r.embedding) for r in df.collect()]
        got = centroids.cluster_vectors(df.repartition(3), clusters=5, rounds=3, dims=6)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_centroids(given, 5, 3, 6, 64)


def test_few_and_far_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(r.distance for r in centroids.cluster_vectors(df, dims=2).collect()) == [0, 0]
    assert centroids.cluster_vectors(df, dims=3).count() == 0 and centroids.cluster_vectors(df.limit(0), dims=2).count() == 0
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    (low, high) = sorted(centroids.integers(far, dims=2).collect(), key=lambda r: r.q)
    assert (low.q, high.q) == ([-centroids.LARGEST, 0], [centroids.LARGEST, 0])
    (row, other) = centroids.cluster_vectors(far, clusters=1, rounds=1, dims=2).collect()
    assert row.distance == other.distance == centroids.LARGEST**2


def test_an_index_is_built_and_stepped_in_little_memory():
    """A shard in bytes a word: what a task holds beyond the index itself while it sorts."""
    text = np.random.default_rng(1).integers(0, 50_000, 200_000).astype(np.int32)
    names = pa.array([f"w{k}" for k in range(1, 50_000)])
    tracemalloc.start()
    forward = collocations._transform(text, 3)
    built = tracemalloc.get_traced_memory()[1] / len(text)
    index = collocations.Index(names, forward.tobytes(), collocations._transform(text[::-1], 3).tobytes())
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    step = index._step(0)
    stepped = (tracemalloc.get_traced_memory()[1] - before) / len(text)
    tracemalloc.stop()
    assert built < 28 and stepped < 20
    assert (step[np.argsort(index.sides[0], kind="stable")] == np.arange(len(text))).all()
