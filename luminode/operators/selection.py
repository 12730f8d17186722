"""Choosing rows: best per bin, adaptive bins, top-k, covers, barcodes, curves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luminode.functions import scalars as S
from luminode.operators.scans import running, with_halo


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the given total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def best_per_bin(df: DataFrame, taxon: str, start: str, width: int, order: list[Column], length: int = 1500) -> DataFrame:
    """The best row of each position bin of a taxon; bins at or beyond floor(length / width) are left out."""
    binned = df.withColumn("bin", S.position_bin(start, width)).where(F.col("bin") < length // width)
    return first_of(binned, [taxon, "bin"], order)


def _marked(df: DataFrame, ok: Column, taxon: str) -> DataFrame:
    """df with __ok, and __any: whether the taxon has such a row. Counted apart, so that no task holds a whole taxon."""
    rows = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    some = rows.where("__ok").select(F.col(taxon).alias("__taxon")).distinct().withColumn("__some", F.lit(True))
    joined = rows.join(some, rows[taxon].eqNullSafe(some["__taxon"]), "left")
    return joined.withColumn("__any", F.coalesce("__some", F.lit(False))).drop("__taxon", "__some")


def with_fallback(df: DataFrame, ok: Column, taxon: str, order: list[Column], fallback: list[Column], bin: str, names: tuple[str, str]) -> DataFrame:
    """Best qualified row per bin; for a taxon without any, its single best row. Column selection_method tells which."""
    marked = _marked(df, ok, taxon)
    good = first_of(marked.where("__ok"), [taxon, bin], order).withColumn("selection_method", F.lit(names[0]))
    single = first_of(marked.where("NOT __any"), [taxon], fallback).withColumn("selection_method", F.lit(names[1]))
    return good.unionByName(single).drop("__ok", "__any")


def adaptive_bins(df: DataFrame, taxon: str, start: str, order: list[Column], widths: tuple[int, ...] = (100, 80, 60, 40, 20), least: int = 15, step: int = 20) -> DataFrame:
    """best_per_bin at the width one step above the first that gives more than `least` rows, else at the last.

    All widths are tried at once, on the best row of each stretch of bases that no bin of any width
    divides; each taxon keeps one of them.
    """
    tried = (widths[0] + step, *widths)
    unit = math.gcd(*tried)
    finest = first_of(df.withColumn("__unit", F.floor(F.col(start) / unit)), [taxon, "__unit"], order).drop("__unit")
    rows = finest.withColumn("bin_width", F.explode(F.array(*map(F.lit, tried)))).withColumn("bin", F.floor(F.col(start) / F.col("bin_width")))
    rows = rows.where(F.col("bin") < F.floor(F.lit(1500) / F.col("bin_width")))
    best = first_of(rows, [taxon, "bin_width", "bin"], order)
    n = best.groupBy(taxon, "bin_width").agg(F.count("*").alias("n"))
    first = F.max(F.when((F.col("n") > least) & (F.col("bin_width") <= widths[0]), F.col("bin_width")))
    chosen = n.groupBy(taxon).agg(F.coalesce(first + step, F.lit(widths[-1])).alias("bin_width"))
    return best.join(chosen, [taxon, "bin_width"])


def all_specific(df: DataFrame, ok: Column, taxon: str, order: list[Column]) -> DataFrame:
    """All qualified rows of a taxon, else its first row."""
    marked = _marked(df, ok, taxon)
    return marked.where("__ok").unionByName(first_of(marked.where("NOT __any"), [taxon], order)).drop("__ok", "__any")


def top_n(df: DataFrame, ok: Column, taxon: str, order: list[Column], n: int) -> DataFrame:
    """The first n qualified rows of a taxon, else its first row."""
    marked = _marked(df, ok, taxon)
    return first_of(marked.where("__ok"), [taxon], order, n).unionByName(first_of(marked.where("NOT __any"), [taxon], order)).drop("__ok", "__any")


def min_cover(cover: DataFrame, key: str, element: str, choice: str, store, max_rounds: int = 1000) -> DataFrame:
    """Greedy set cover of every key at once: in each round each key takes the choice that covers most uncovered elements.

    Ties go to the smaller choice. store(df) cuts the lineage of a round (a checkpoint or a written
    table). Gives key, choice and the round in which it was taken. A choice's rows lie together, and what
    a round covers is stored by itself, so that a small one reaches the rows without a shuffle of them.
    """
    left, chosen = store(cover.select(key, element, choice).repartition(key, choice).distinct()), None
    for k in range(max_rounds + 1):
        if k == max_rounds:
            raise RuntimeError(f"elements are left after {max_rounds} rounds")
        counts = left.groupBy(key, choice).agg(F.count("*").alias("n"))
        best = store(counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(choice).alias("c"))).alias("b")).select(key, F.col("b.c").alias(choice), F.lit(k + 1).alias("round")))
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.union(best)
        covered = store(left.join(best, [key, choice]).select(key, element).distinct())
        left = store(left.join(covered, [key, element], "left_anti"))
    return chosen


def without_redundant(cover: DataFrame, chosen: DataFrame, key: str, element: str, choice: str, store) -> DataFrame:
    """The chosen rows without those that the others make up for: the last taken goes first, until none is redundant.

    chosen: key, choice, round, as min_cover gives them. A choice is redundant where each of its
    elements has another choice; every key drops one in a round.
    """
    kept = store(chosen.select(key, choice, "round"))
    pairs = store(cover.select(key, element, choice).join(chosen.select(key, choice), [key, choice], "left_semi").distinct())
    while True:
        now = pairs.join(kept, [key, choice])
        times = now.groupBy(key, element).agg(F.count("*").alias("times"))
        spare = now.join(times, [key, element]).groupBy(key, choice, "round").agg(F.min("times").alias("least")).where("least > 1")
        gone = store(spare.groupBy(key).agg(F.max_by(choice, "round").alias(choice)))
        if gone.isEmpty():
            return kept
        kept = store(kept.join(gone, [key, choice], "left_anti"))


def cover_bound(cover: DataFrame, chosen: DataFrame, key: str, element: str, choice: str) -> DataFrame:
    """key and lower_bound: no cover of the key is smaller.

    Each element pays an equal share of the greedy choice that first covered it. No choice is paid
    more than `most` by its elements, so prices over `most` are a solution of the dual problem,
    whose sum bounds every cover from below.
    """
    rows = cover.select(key, element, choice).distinct()
    first = rows.join(chosen.select(key, choice, "round"), [key, choice]).groupBy(key, element).agg(F.min("round").alias("round"))
    fresh = first.groupBy(key, "round").agg(F.count("*").alias("fresh"))
    price = first.join(fresh, [key, "round"]).select(key, element, (1 / F.col("fresh")).alias("price"))
    paid = rows.join(price, [key, element]).groupBy(key, choice).agg(F.sum("price").alias("paid"))
    most = paid.groupBy(key).agg(F.max("paid").alias("most"))
    total = price.groupBy(key).agg(F.sum("price").alias("total"))
    return total.join(most, key).select(key, F.ceil(F.col("total") / F.col("most") - 1e-9).alias("lower_bound"))


def assign_barcodes(taxa: DataFrame, spark, bits: int, order: str = "sequential", taxon: str = "taxon", seed: int = 0) -> DataFrame:
    """A code for each of the first 2^bits - 1 taxa, by string order of their names.

    order: sequential, simple (few set bits first), complex (many first) or random (by seeded hash).
    """
    n = F.col("number")
    by = {"sequential": [n], "simple": [F.bit_count(n), n], "complex": [-F.bit_count(n), n], "random": [F.xxhash64(n, F.lit(seed)), n]}[order]
    # a code table has 2^bits - 1 rows, and so has the list of taxa that get one
    codes = spark.range(1, 2**bits).select(F.col("id").alias("number")).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    named = taxa.select(F.col(taxon).cast("string").alias(taxon)).distinct().orderBy(taxon).limit(2**bits - 1)
    ranked = named.withColumn("rank", F.row_number().over(Window.orderBy(taxon)))
    return ranked.join(codes, "rank").select(taxon, "number", S.to_bits("number", bits).alias("code"))


def cumulative_coverage(df: DataFrame, taxon: str, gain: str, order: list[Column], marks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Running sum of gains by taxon: at its last row and at each mark (null where it has fewer rows)."""
    run = running(df, [taxon], order, "__i", {"__c": gain})
    return run.groupBy(taxon).agg(F.max_by("__c", "__i").alias("total"), *[F.max(F.when(F.col("__i") == m, F.col("__c"))).alias(f"at_{m}") for m in marks])


def replicate_consensus(df: DataFrame, keys: list[str], code: str, distance: str, replicate: str, bits: int = 7) -> DataFrame:
    """The code of the replicate with the smallest distance (ties: the first); a missing code is all zeros at distance 1."""
    filled = df.select(*keys, replicate, F.coalesce(F.when(F.col(code).isNotNull(), F.col(distance)), F.lit(1.0)).alias("d"), F.coalesce(F.col(code), F.lit("0" * bits)).alias("c"))
    return filled.groupBy(*keys).agg(F.min(F.struct("d", replicate, "c")).alias("b")).select(*keys, F.col("b.c").alias(code), F.col("b.d").alias(distance))


def rank_classes(long: DataFrame, a: str, b: str, value: str, n: int = 20) -> DataFrame:
    """The n classes with the largest sum of |value| over pairs that hold them."""
    return long.groupBy(F.col(a).alias("code")).agg(F.sum(F.abs(value)).alias("weight")).orderBy(F.desc(F.round("weight", 9)), "code").limit(n)


# Smoothing weights of a cubic least-squares fit follow from the window by the rule below.
def smoothing_weights(half: int = 20) -> list[float]:
    """Weights of the centre value of a cubic fit to 2 * half + 1 equally spaced values."""
    m = half
    scale = (2 * m + 3) * (2 * m + 1) * (2 * m - 1)
    return [3 * (3 * m * m + 3 * m - 1 - 5 * k * k) / scale for k in range(-m, m + 1)]


def smoothing_table(half: int = 20) -> list[list[float]]:
    """For each place of a window the weights that give there the cubic fitted to the whole window."""
    t = np.arange(-half, half + 1, dtype=float)
    basis, _ = np.linalg.qr(np.stack([t**k for k in range(4)], axis=1))
    return (basis @ basis.T).tolist()


def smooth(df: DataFrame, keys: list[str], order: list[Column], value: str, half: int = 20) -> DataFrame:
    """Running cubic smoothing, clipped to 0..1, of values without nulls.

    The first and last `half` rows of a group lie on the cubic fitted to its first or last window;
    groups smaller than a window have null. A long group is smoothed in blocks of rows.
    """
    size = 2 * half + 1
    rows, is_own = with_halo(df, keys, order, "__i", 2 * half)
    whole = df.groupBy(*keys).agg(F.count("*").alias("__n")).withColumnsRenamed({k: f"__{k}" for k in keys})
    match = rows[keys[0]].eqNullSafe(whole[f"__{keys[0]}"])
    for k in keys[1:]:
        match = match & rows[k].eqNullSafe(whole[f"__{k}"])
    rows = rows.join(whole, match, "left").drop(*[f"__{k}" for k in keys])
    w = Window.partitionBy(*keys, "__block").orderBy("__i")
    rows = rows.withColumn("__around", F.collect_list(value).over(w.rowsBetween(-2 * half, 2 * half))).where(is_own).withColumn("__at", F.col("__i") - 1)
    place = F.when(F.col("__at") < half, F.col("__at")).when(F.col("__n") - 1 - F.col("__at") < half, 2 * half - (F.col("__n") - 1 - F.col("__at"))).otherwise(half).cast("int")
    begin = F.col("__at") - place - F.greatest(F.lit(0), F.col("__at") - 2 * half)
    weights = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in smoothing_table(half)]), place + 1)
    terms = F.zip_with(F.slice("__around", (begin + 1).cast("int"), F.lit(size)), weights, lambda x, k: x * k)
    fitted = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("smoothed", F.when(F.col("__n") >= size, F.greatest(F.lit(0.0), F.least(F.lit(1.0), fitted)))).drop("__at", "__n", "__i", "__around", "__own", "__block")


def name_rows(df: DataFrame, prefix: str, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows named prefix_1, prefix_2, ... in order, within keys."""
    return df.withColumn("name", F.concat(F.lit(f"{prefix}_"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")))
