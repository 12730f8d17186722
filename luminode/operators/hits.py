"""Gapped hits of probes on targets: minimiser seeds, chains of near diagonals, affine-gap extension."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators import align
from luminode.operators.similar import mix
from luminode.sources.shared import stored

#: Places of a seed in the targets that one task takes; a more frequent seed is dealt to several.
SPREAD = 5000
# The usual search's constants of the distribution of scores (match 1, mismatch -3).
LAMBDA, KAPPA = 1.374, 0.711
HIT = "probe_id, strand, molecule_id, score, probe_start, probe_end, molecule_start, molecule_end, length, matches, mismatch, gapopen, qseq, sseq"


def kmer_keys(seq: str, k: int) -> np.ndarray:
    """A 64-bit key of each k-mer of a sequence."""
    if len(seq) < k:
        return np.empty(0, np.uint64)
    letters = np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n, out = len(letters) - k + 1, np.zeros(len(letters) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + letters[i : i + n]
    return mix(out)


def seeds(df: DataFrame, id: str, seq: str, k: int, window: int = 1, position: str = "i") -> DataFrame:
    """(id, position, seed): of every `window` k-mers in a row the one with the least key (all where window is 1).

    A stretch of k + window - 1 letters so always has a seed, the same wherever it stands.
    """
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys = kmer_keys(batch.column(1)[r].as_py() or "", k)
                if not len(keys):
                    continue
                at = np.arange(len(keys))
                if window > 1:
                    w = min(window, len(keys))
                    at = np.unique(np.lib.stride_tricks.sliding_window_view(keys, w).argmin(axis=1) + np.arange(len(keys) - w + 1))
                ids = batch.column(0).take(pa.array(np.full(len(at), r)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(keys[at].view(np.int64))], ["id", position, "seed"])

    return df.select(id, seq).mapInArrow(run, f"id {kind}, {position} int, seed long").withColumnRenamed("id", id)


def chains(probes: DataFrame, targets: DataFrame, k: int, window: int, band: int) -> DataFrame:
    """(probe_id, strand, molecule_id, low, high): stretches of diagonals, at most `band` apart, with a common seed.

    probes: probe_id, strand, seq; targets: molecule_id, seq. The places of a frequent seed are dealt
    to several tasks, each of which is given the probes' side.
    """
    p = stored(seeds(probes.withColumn("__p", F.struct("probe_id", "strand")).select(F.to_json("__p").alias("p"), "seq"), "p", "seq", k), "probe-seeds")
    t = stored(seeds(targets, "molecule_id", "seq", k, window, "j").join(p.select("seed").distinct(), "seed", "left_semi"), "target-seeds")
    heavy = t.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD).select("seed", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts"))
    heavy = stored(heavy, "frequent-seeds")
    salted = lambda df: df.join(heavy, "seed", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = salted(p).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = salted(t).withColumn("part", F.pmod(F.xxhash64("molecule_id", "j"), F.col("parts")).cast("int")).drop("parts")
    met = left.join(right, ["seed", "part"]).select("p", "molecule_id", (F.col("j") - F.col("i")).alias("diagonal")).distinct()
    along = Window.partitionBy("p", "molecule_id").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= band, 0).otherwise(1)
    numbered = met.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    kind = f"probe_id {probes.schema['probe_id'].dataType.simpleString()}, strand string"
    out = numbered.groupBy("p", "molecule_id", "chain").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    return out.withColumn("p", F.from_json("p", kind)).select("p.probe_id", "p.strand", "molecule_id", "low", "high")


def gapped_hits(probes: DataFrame, targets: DataFrame, k: int = 11, window: int = 4, band: int = 16, least: int = 16) -> DataFrame:
    """Local alignments of probes with targets on both strands: one for each chain of seeds, of at least score `least`.

    probes: probe_id, seq; targets: molecule_id, seq (null: no hit). Every exact match of k + window - 1
    letters gives a seed; seeds on diagonals at most `band` apart are one chain, whose stretch of the
    target, wider by `band` at both ends, is aligned with the whole probe: affine gaps, the scores of
    align. Starts and ends count from 1, ends included, on the given strand of the target (the
    reverse strand's probe is the reverse complement). bitscore and evalue follow from the score,
    the probe's length and all letters of the targets. Chains that find the same stretch are one hit.
    """
    targets = targets.where("seq IS NOT NULL").select("molecule_id", "seq")
    probes = probes.where("seq IS NOT NULL").select("probe_id", "seq")
    strands = probes.select("probe_id", F.lit("+").alias("strand"), "seq").union(probes.select("probe_id", F.lit("-"), S.reverse_complement("seq")))
    found = stored(chains(strands, targets, k, window, band), "chains")
    cut = found.join(strands.withColumnRenamed("seq", "q"), ["probe_id", "strand"])
    first = F.greatest(F.lit(0), F.col("low") - band)
    # a target's text meets its chains once and leaves as their stretches; Spark splits the chains of one target
    whole = cut.join(targets, "molecule_id", "left").withColumn("first", first)
    rows = whole.select("probe_id", "strand", "molecule_id", "first", "q", F.substring(F.col("seq"), F.col("first") + 1, F.col("high") + band + F.length("q") - F.col("first")).alias("t"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"probe_id {kind('probe_id')}, strand string, molecule_id {kind('molecule_id')}, score int, probe_start int, probe_end int, molecule_start int, molecule_end int, qseq string, sseq string, q_length int"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 2000) for whole in batches for k in range(0, whole.num_rows, 2000)):
            q, t, first = batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(3).to_pylist()
            got = align.align(q, t, least=least)
            kept = [r for r, a in enumerate(got) if a]
            number = lambda value: pa.array([value(got[r], first[r], q[r]) for r in kept], pa.int32())
            text = lambda value: pa.array([value(got[r]) for r in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1, 2)],
                    number(lambda a, f, q: a.score),
                    number(lambda a, f, q: a.query_start + 1),
                    number(lambda a, f, q: a.query_end),
                    number(lambda a, f, q: f + a.target_start + 1),
                    number(lambda a, f, q: f + a.target_end),
                    text(lambda a: a.query),
                    text(lambda a: a.target),
                    number(lambda a, f, q: len(q)),
                ],
                ["probe_id", "strand", "molecule_id", "score", "probe_start", "probe_end", "molecule_start", "molecule_end", "qseq", "sseq", "q_length"],
            )

    hits = rows.repartition("probe_id", "molecule_id", "first").mapInArrow(extend, schema)
    hits = hits.dropDuplicates(["probe_id", "strand", "molecule_id", "probe_start", "probe_end", "molecule_start", "molecule_end"])
    space = targets.agg(F.sum(F.length("seq"))).first()[0] or 0
    gaps = lambda c: F.size(F.filter(F.split(c, "[^-]+"), lambda x: x != ""))
    pairs = F.arrays_zip(F.split("qseq", "").alias("a"), F.split("sseq", "").alias("b"))
    matches = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    bits = (LAMBDA * F.col("score") - math.log(KAPPA)) / math.log(2)
    out = hits.withColumns({"length": F.length("qseq"), "matches": matches, "gapopen": gaps("qseq") + gaps("sseq"), "bitscore": bits})
    gap_letters = F.length("qseq") + F.length("sseq") - F.length(F.replace("qseq", F.lit("-"))) - F.length(F.replace("sseq", F.lit("-")))
    out = out.withColumns({"mismatch": F.col("length") - F.col("matches") - gap_letters, "evalue": F.col("q_length") * float(space) * F.pow(F.lit(2.0), -F.col("bitscore")), "pid": 100.0 * F.col("matches") / F.col("length")})
    out = out.withColumns({"qcovhsp": 100.0 * (F.col("probe_end") - F.col("probe_start") + 1) / F.col("q_length"), "mch": S.max_homology("qseq", "sseq")})
    return out.drop("q_length")
