"""Aggregations over pixels, cells, networks of classes, and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from luminode.functions import scalars as S
from luminode.operators import joins as J
from luminode.operators.scans import running
from luminode.sources.shared import stored

#: Bootstrap draws that a task counts.
TASK_DRAWS = 500_000


def measure_regions(pixels: DataFrame, keys: tuple[str, ...] = ("image_id", "label"), intensity: str | None = None, spectrum: str | None = None) -> DataFrame:
    """Area, centroid, axes, eccentricity and orientation of every region, from second moments.

    With intensity its mean and total; with spectrum (an array column) its mean in each channel.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    more = [F.avg(intensity).alias("mean_intensity"), F.sum(intensity).alias("total_intensity")] if intensity else []
    m = pixels.groupBy(*keys).agg(F.count("*").alias("area"), F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"), F.var_pop(x).alias("__xx"), F.var_pop(y).alias("__yy"), F.covar_pop(x, y).alias("__xy"), *more)
    # each pixel is a unit square, which has second moment 1/12
    xx, yy, xy = F.col("__xx") + 1 / 12, F.col("__yy") + 1 / 12, F.col("__xy")
    root = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    out = m.withColumns({"major_axis": 4 * F.sqrt((xx + yy + root) / 2), "minor_axis": 4 * F.sqrt((xx + yy - root) / 2), "orientation": 0.5 * F.atan2(2 * xy, xx - yy)})
    ratio = F.col("minor_axis") / F.col("major_axis")
    out = out.withColumn("eccentricity", F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio))).drop("__xx", "__yy", "__xy")
    return out.join(mean_array(pixels, list(keys), spectrum), list(keys)) if spectrum else out


def mean_array(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Element-wise mean of arrays, in order."""
    long = df.select(*keys, F.posexplode(v).alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("m"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias(v))


def spectral_centroid(pixels: DataFrame, keys: list[str], v: str = "intensity") -> DataFrame:
    """Median and deviation over channels of the distance of a region's intensity-weighted centroid to its plain one."""
    plain = pixels.groupBy(*keys).agg(F.avg("x").alias("__x"), F.avg("y").alias("__y"))
    long = pixels.select(*keys, "x", "y", F.posexplode(v).alias("k", "w"))
    each = long.groupBy(*keys, "k").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("wx"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("wy"))
    dx, dy = F.col("wx") - F.col("__x"), F.col("wy") - F.col("__y")
    return each.join(plain, keys).groupBy(*keys).agg(F.percentile(F.sqrt(dx * dx + dy * dy), 0.5).alias("centroid_distance"), F.stddev_pop(F.sqrt(dx * dx + dy * dy)).alias("centroid_deviation"))


def pair_centroid(pixels: DataFrame, v: str = "intensity", image: str = "image_id") -> DataFrame:
    """spectral_centroid of the union of every two touching regions."""
    pairs = J.adjacency(pixels, image, both=False)
    either = pairs.select(image, "label_1", "label_2", F.explode(F.array("label_1", "label_2")).alias("label"))
    return spectral_centroid(either.join(pixels, [image, "label"]), [image, "label_1", "label_2"], v)


def separation_rate(df: DataFrame, distance: str, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Share of rows with a distance above each threshold."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return rows.groupBy(*keys, "threshold").agg(F.avg((F.col(distance) > F.col("threshold")).cast("double")).alias("separated"))


def spectrum_histogram(df: DataFrame, v: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """log10(n + 1) of the values in each channel and intensity bin (1 to bins; 0 and bins + 1 lie outside)."""
    long = df.select(F.posexplode(v).alias("channel", "x"))
    return long.groupBy("channel", F.expr(f"width_bucket(x, {low}D, {high}D, {bins})").alias("bin")).agg(F.log10(F.count("*") + 1).alias("log_n"))


def _quantile(c: Column | str, share: float, accuracy: int | None) -> Column:
    """The exact quantile, or with a mergeable sketch one whose rank is off by at most 1 / accuracy."""
    return F.percentile(c, share) if accuracy is None else F.percentile_approx(c, share, accuracy)


def distance_profile(df: DataFrame, keys: list[str], sample: str, distance: str, width: float, bins: int, accuracy: int | None = None) -> DataFrame:
    """Share of a sample's rows in each distance bin: mean and quartiles over samples, empty bins as 0.

    Quartiles are exact, or within 1 / accuracy of their rank, at bounded memory.
    """
    counts = df.where((F.col(distance) >= 0) & (F.col(distance) < width * bins)).groupBy(*keys, sample, F.floor(F.col(distance) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = df.groupBy(*keys, sample).agg(F.count("*").alias("total")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = total.join(counts, [*keys, sample, "bin"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("total"))
    return full.groupBy(*keys, "bin").agg(F.avg("share").alias("mean"), _quantile("share", 0.25, accuracy).alias("q25"), _quantile("share", 0.75, accuracy).alias("q75"))


def compare_groups(df: DataFrame, category: str, group: str, value: str, groups: tuple, fill: float = 0.1, accuracy: int | None = None) -> DataFrame:
    """Mean, deviation and quartiles of a category's values in two groups; a missing mean is `fill`. accuracy as in distance_profile."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    cols = []
    for k, g in enumerate(groups, 1):
        cols += [F.coalesce(F.avg(of(g)), F.lit(fill)).alias(f"mean_{k}"), F.stddev_samp(of(g)).alias(f"std_{k}"), _quantile(of(g), 0.25, accuracy).alias(f"q25_{k}"), _quantile(of(g), 0.75, accuracy).alias(f"q75_{k}")]
    return df.groupBy(category).agg(*cols)


def error_rate(df: DataFrame, keys: list[str], wrong: Column) -> DataFrame:
    """Share of wrong codes; where it is 0 the detection limit 1/n, flagged."""
    out = df.groupBy(*keys).agg(F.avg(wrong.cast("double")).alias("__r"), F.count("*").alias("n"))
    return out.select(*keys, "n", F.when(F.col("__r") == 0, 1 / F.col("n")).otherwise(F.col("__r")).alias("error_rate"), (F.col("__r") == 0).alias("at_limit"))


def hamming_histogram(df: DataFrame, keys: list[str], distance: str, bits: int) -> DataFrame:
    """Rows at each Hamming distance 0..bits, with zeros."""
    spine = df.select(*keys).distinct().withColumn("hd", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    return spine.join(df.groupBy(*keys, F.col(distance).alias("hd")).agg(F.count("*").alias("n")), [*keys, "hd"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sigma_gate(df: DataFrame, image: str, columns: list[str], mode: str = "within") -> DataFrame:
    """within: rows inside mean +- population deviation of their image in all columns; above: above mean - sample deviation.

    An image's figures are one row, joined back, so that its rows need not meet in one task. Whole and
    decimal columns are decided by exact sums, n (v - mean) against n times the deviation, both
    squared: a value that lies on the limit counts the same way in any order of rows. For floating
    columns the mean and the deviation are doubles.
    """
    spread = F.stddev_pop if mode == "within" else F.stddev_samp
    kinds = {c: df.schema[c].dataType for c in columns}
    exact = {c: kind if isinstance(kind, DecimalType) else DecimalType(20, 0) for c, kind in kinds.items() if isinstance(kind, (DecimalType, IntegralType))}
    figures = []
    for k, c in enumerate(columns):
        if c in exact:
            v = F.col(c).cast(exact[c])
            figures += [F.count(c).alias(f"__n{k}"), F.sum(v).alias(f"__sum{k}"), F.sum(v * v).alias(f"__square{k}")]
        else:
            figures += [F.avg(c).alias(f"__mean{k}"), spread(c).alias(f"__dev{k}")]
    stats = df.groupBy(F.col(image).alias("__image")).agg(*figures)
    ok = F.lit(True)
    for k, c in enumerate(columns):
        if c in exact:
            n, total = F.col(f"__n{k}").cast("decimal(12,0)"), F.col(f"__sum{k}")
            off = n * F.col(c).cast(exact[c]) - total
            off = off.cast(DecimalType(38, exact[c].scale))
            square = n * F.col(f"__square{k}") - total * total
            if mode == "within":
                ok = ok & (off * off <= square)
            else:
                ok = ok & (n > 1) & ((off > 0) | ((n - 1) * (off * off) < n * square))
        else:
            mean, deviation = F.col(f"__mean{k}"), F.col(f"__dev{k}")
            ok = ok & ((F.abs(F.col(c) - mean) <= deviation) if mode == "within" else (F.col(c) > mean - deviation))
    return df.join(stats, df[image].eqNullSafe(stats["__image"]), "left").where(ok).select(*df.columns)


def adjacency_counts(edges: DataFrame, cells: DataFrame, image: str = "image_id") -> DataFrame:
    """Touching pairs by the classes (code) of both cells."""
    of = lambda k: cells.select(image, F.col("label").alias(f"label_{k}"), F.col("code").alias(f"code_{k}"))
    return edges.join(of(1), [image, "label_1"]).join(of(2), [image, "label_2"]).groupBy(image, "code_1", "code_2").agg(F.count("*").alias("n"))


def association(counts: DataFrame, cells: DataFrame, image: str = "image_id") -> DataFrame:
    """Adjacency over the product of the classes' sizes."""
    sizes = cells.groupBy(image, "code").agg(F.count("*").alias("size"))
    of = lambda k: sizes.select(image, F.col("code").alias(f"code_{k}"), F.col("size").alias(f"size_{k}"))
    return counts.join(of(1), [image, "code_1"]).join(of(2), [image, "code_2"]).select(image, "code_1", "code_2", (F.col("n") / (F.col("size_1") * F.col("size_2"))).alias("association"))


def permutation_null(edges: DataFrame, cells: DataFrame, n_sim: int, key: Column | None = None, seed: int = 0, image: str = "image_id") -> DataFrame:
    """Adjacency counts under permuted classes: mean and deviation over simulations, and fold change of the observed.

    In each simulation an image's classes are dealt to its cells in the order of a hash of
    (simulation, label, seed); key replaces the hash (it may use columns sim and label).
    """
    sims = cells.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n_sim))))
    order = key if key is not None else F.xxhash64("sim", "label", F.lit(seed))
    w = Window.partitionBy(image, "sim")
    places = sims.select(image, "sim", "label", F.row_number().over(w.orderBy("label")).alias("r"))
    dealt = sims.select(image, "sim", "code", F.row_number().over(w.orderBy(order, "label")).alias("r"))
    shuffled = places.join(dealt, [image, "sim", "r"]).drop("r")
    of = lambda k: shuffled.select(image, "sim", F.col("label").alias(f"label_{k}"), F.col("code").alias(f"code_{k}"))
    null = edges.join(of(1), [image, "label_1"]).join(of(2), [image, "sim", "label_2"]).groupBy(image, "code_1", "code_2", "sim").agg(F.count("*").alias("n"))
    # simulations without the pair count 0
    mean = F.sum("n") / n_sim
    stats = null.groupBy(image, "code_1", "code_2").agg(mean.alias("null_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("n")) / n_sim - mean * mean)).alias("null_std"))
    both = stats.join(adjacency_counts(edges, cells, image), [image, "code_1", "code_2"], "full")
    both = both.select(image, "code_1", "code_2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "null_mean", "null_std")])
    return both.withColumn("fold_change", (F.col("n") + 1) / (F.col("null_mean") + 1))


def permutation_moments(edges: DataFrame, cells: DataFrame, image: str = "image_id") -> DataFrame:
    """The permutation null model without simulations: exact mean and deviation of every pair of classes.

    An image's classes are dealt to its cells in all orders alike. With m touching pairs, of which s
    pairs of pairs share a cell, the first two moments of a count follow from the sizes of the two
    classes: the chance that one pair, two pairs with a common cell, or two without one join them.
    edges: both directions of every pair; pairs within a class count twice, as in adjacency_counts.
    """
    ends = [cells.select(image, F.col("label").alias(f"label_{k}")).distinct() for k in (1, 2)]
    once = edges.select(image, "label_1", "label_2").where("label_1 <> label_2").distinct()
    once = once.join(ends[0], [image, "label_1"], "left_semi").join(ends[1], [image, "label_2"], "left_semi")
    degrees = once.groupBy(image, "label_1").agg(F.count("*").alias("d"))
    graph = degrees.groupBy(image).agg((F.sum("d") / 2).alias("m"), (F.sum(F.col("d") * (F.col("d") - 1)) / 2).alias("s"))
    sizes = cells.groupBy(image, "code").agg(F.count_distinct("label").cast("double").alias("size"))
    total = sizes.groupBy(image).agg(F.sum("size").alias("cells"))
    of = lambda k: sizes.select(image, F.col("code").alias(f"code_{k}"), F.col("size").alias(f"size_{k}"))
    rows = of(1).join(of(2), image).join(total, image).join(graph, image)
    a, b, n, m, s = (F.col(c) for c in ("size_1", "size_2", "cells", "m", "s"))
    same = F.col("code_1") == F.col("code_2")

    def falling(x, k: int):
        out = x
        for i in range(1, k):
            out = out * (x - i)
        return out

    def chance(equal, unequal, k: int):
        return F.when(n >= k, F.when(same, equal).otherwise(unequal) / falling(n, k)).otherwise(0.0)

    one = chance(falling(a, 2), 2 * a * b, 2)
    shared = chance(falling(a, 3), a * b * (a + b - 2), 3)
    apart = chance(falling(a, 4), 4 * falling(a, 2) * falling(b, 2), 4)
    mean, square = m * one, m * one + 2 * s * shared + (m * (m - 1) - 2 * s) * apart
    twice = F.when(same, 2.0).otherwise(1.0)
    rows = rows.withColumns({"null_mean": twice * mean, "null_std": twice * F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))})
    out = rows.join(adjacency_counts(once, cells, image), [image, "code_1", "code_2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    z = F.when(F.col("null_std") > 1e-9, (F.col("n") - F.col("null_mean")) / F.col("null_std"))
    return out.select(image, "code_1", "code_2", "n", "null_mean", "null_std", ((F.col("n") + 1) / (F.col("null_mean") + 1)).alias("fold_change"), z.alias("z"))


def network_distance(a: DataFrame, b: DataFrame, keys: tuple[str, str] = ("code_1", "code_2"), n: str = "n", log: bool = False) -> DataFrame:
    """One row: sum of squared differences of two networks without diagonal, each over its largest count (or of their log10(n + 1))."""
    off = f"{keys[0]} <> {keys[1]}"

    def scaled(df, name):
        df = df.where(off).select(*keys, F.col(n).cast("double").alias(name))
        return df.withColumn(name, F.log10(F.col(name) + 1)) if log else df.join(F.broadcast(df.agg(F.max(name).alias("__m"))), F.lit(True)).withColumn(name, F.col(name) / F.col("__m")).drop("__m")

    both = scaled(a, "p").join(scaled(b, "q"), list(keys), "full")
    d = F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return both.agg(F.sum(d * d).alias("distance"))


def pair_ttest(df: DataFrame, keys: list[str], group: str, value: str, groups: tuple, hypotheses: int | None = None) -> DataFrame:
    """Equal-variance two-sample t of each key, degrees of freedom, p-value, fold change and the Bonferroni verdict."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    parts = [f(of(g)).alias(f"{name}{k}") for k, g in enumerate(groups, 1) for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))]
    s = df.groupBy(*keys).agg(*parts).where("n1 > 1 AND n2 > 1")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    s = s.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).withColumn("df", F.col("n1") + F.col("n2") - 2)
    s = s.withColumns({"fold_change": F.col("m1") / F.col("m2"), "p_value": t_tail(F.col("t"), F.col("df"))})
    if hypotheses:
        return s.withColumn("significant", F.col("p_value") < 0.05 / hypotheses)
    # one row
    total = F.broadcast(s.agg(F.count("*").alias("__total")))
    return s.crossJoin(total).withColumn("significant", F.col("p_value") < 0.05 / F.col("__total")).drop("__total")


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t, by the incomplete beta function."""
    return beta_tail(df / (df + t * t), df / 2, F.lit(0.5))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    return beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def beta_tail(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction, in numpy batches."""
    import numpy as np
    import pandas as pd

    def fraction(x, a, b):
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        out = d.copy()
        for m in range(1, 200):
            for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + numerator * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + numerator / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                out *= c * d
        return out

    def tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        x, a, b = (s.to_numpy(dtype=float) for s in (x, a, b))
        gamma = np.vectorize(math.lgamma, otypes=[float])
        low = x < (a + 1) / (a + b + 2)
        with np.errstate(all="ignore"):
            front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x))
            left = front * fraction(np.where(low, x, 0.0), a, b) / a
            right = 1 - front * fraction(np.where(low, 0.0, 1 - x), b, a) / b
        return pd.Series(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, left, right))))

    tail.__annotations__ = {"x": pd.Series, "a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(tail, "double")(x.cast("double"), a.cast("double"), b.cast("double"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: F of a one-way analysis of variance, its degrees of freedom and p-value."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0")
    total = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    out = total.select((F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), between.alias("between"), "within")
    out = out.withColumn("f", (F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2")))
    return out.withColumn("p_value", f_tail(F.col("f"), F.col("df1"), F.col("df2"))).select("f", "df1", "df2", "p_value")


def corr_matrix(df: DataFrame, category: str, sample: str, value: str) -> DataFrame:
    """Pearson correlation of every two categories over the samples that have both."""
    a = df.select(sample, F.col(category).alias("i"), F.col(value).alias("u"))
    b = df.select(sample, F.col(category).alias("j"), F.col(value).alias("w"))
    return a.join(b, sample).groupBy("i", "j").agg(F.corr("u", "w").alias("r"), F.count("*").alias("n"))


def regress(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and r2 of y on x, and the sum of y where x is 0 (gross error)."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.sum(F.when(F.col(x) == 0, F.col(y)).otherwise(0)).alias("gross_error"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, id: str, replicates: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Mean and quartiles of bootstrap means: n draws with replacement per replicate, by seeded hashes.

    Rows are numbered by id in parts, so a key with very many rows is split. draw (a long column, which
    may use the keys, replicate and i) replaces the hash. Replicates are few: their quartiles are exact.
    Rows and draws are dealt to so many tasks that each holds about TASK_DRAWS draws.
    """
    numbered = running(df.select(*keys, value, id), keys, [F.col(id)], "i").select(*keys, value, F.col("i").cast("long").alias("i"))
    sizes = stored(df.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total * replicates / TASK_DRAWS))
    numbered = numbered.repartition(parts, *keys, "i")
    draws = numbered.join(sizes, keys, "left").select(*keys, "n", "i", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = draw if draw is not None else F.xxhash64(*keys, "replicate", "i", F.lit(seed))
    # equal draws are counted before they meet the values
    dealt = draws.select(*keys, "replicate", (F.pmod(drawn, F.col("n")) + 1).alias("i")).repartition(parts, *keys, "i")
    counted = dealt.groupBy(*keys, "replicate", "i").agg(F.count("*").alias("times"))
    means = counted.join(numbered, [*keys, "i"]).groupBy(*keys, "replicate").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    return means.groupBy(*keys).agg(F.avg("m").alias("mean"), F.percentile("m", 0.25).alias("q25"), F.percentile("m", 0.75).alias("q75"))


def quantile_sketches(df: DataFrame, keys: list[str], value: str, size: int = 400) -> DataFrame:
    """keys, n and a sketch of each group's values, bounded in size: it merges with others, batch by batch or level by level.

    The rank of a quantile read from it is off by about 1.33 / size ** 0.9 * 200 ** 0.9 per cent of n
    (0.7 % at 400), with a probability of 99 %. Null values are left out.
    """
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75), size: int = 400) -> DataFrame:
    """keys, n and the quantiles q25, q50, ... of merged sketches."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{round(100 * p):02}") for p in shares])


def pair_correlation(cells: DataFrame, dr: float, rings: int, side: float, area: float, keys: tuple[str, ...] = ("image_id", "code")) -> DataFrame:
    """g(r) of each class: pairs in ring k over those expected; pairs near an edge weigh by the arc inside.

    Cells lie in -side..side in both directions; ring k is k dr - dr/2 < r < k dr + dr/2.
    """
    pairs = J.pairs_within(cells, dr * (rings + 0.5), keys)
    both = pairs.select(*keys, F.col("x_1").alias("x"), F.col("y_1").alias("y"), "distance").union(pairs.select(*keys, "x_2", "y_2", "distance"))
    both = both.withColumn("k", F.round(F.col("distance") / dr).cast("int")).where((F.col("k") >= 1) & (F.col("k") <= rings) & (F.abs(F.col("distance") - F.col("k") * dr) < dr / 2))
    edge = F.greatest(F.lit(0.0), F.least(side - F.abs("x"), side - F.abs("y")))
    r = F.col("k") * dr
    arc = F.when(r >= edge, (2 * math.pi - 2 * F.acos(edge / r)) / (2 * math.pi)).otherwise(1.0)
    rings_ = both.withColumn("w", 1 / arc).groupBy(*keys, "k").agg(F.sum("w").alias("s"))
    n = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    return rings_.join(n, list(keys)).select(*keys, "k", (area * F.col("s") / (F.col("n") * F.col("n") * 2 * math.pi * F.col("k") * dr * dr)).alias("g"))


def _shannon(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    from luminode.operators.summaries import diversity

    return diversity(df.groupBy(*keys, code).agg(F.count("*").alias("n")), keys).select(*keys, "shannon")


def beta_diversity(cells: DataFrame, points: DataFrame, sizes: list[int], image: str = "image_id", mode: str = "ratio_of_means") -> DataFrame:
    """Shannon index of an image over that of patches: the n cells nearest to each point, for each n.

    ratio_of_means divides by the mean patch index, mean_of_ratios averages the ratios of patches
    with a positive index.
    """
    near = J.knn_points(points, cells, max(sizes), image)
    patches = near.withColumn("n_cell", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= n_cell")
    alpha = _shannon(patches, [image, "point_id", "n_cell"], "code").withColumnRenamed("shannon", "alpha")
    gamma = _shannon(cells, [image], "code").withColumnRenamed("shannon", "gamma")
    beta = F.first("gamma") / F.avg("alpha") if mode == "ratio_of_means" else F.avg(F.when(F.col("alpha") > 0, F.col("gamma") / F.col("alpha")))
    return alpha.join(gamma, image).groupBy(image, "n_cell").agg(beta.alias("beta"))


def bray_curtis(patches: DataFrame, pairs: DataFrame, code: str = "code") -> DataFrame:
    """Bray-Curtis dissimilarity of two patches and the distance of their area-weighted centres.

    patches: patch_id, code, x, y, area (a row per cell); pairs: patch_1, patch_2.
    """
    counts = patches.groupBy("patch_id", code).agg(F.count("*").alias("n"))
    centre = patches.groupBy("patch_id").agg((F.sum(F.col("x") * F.col("area")) / F.sum("area")).alias("cx"), (F.sum(F.col("y") * F.col("area")) / F.sum("area")).alias("cy"))
    a = pairs.join(counts.select(F.col("patch_id").alias("patch_1"), code, F.col("n").alias("a"), F.lit(0).alias("b")), "patch_1")
    b = pairs.join(counts.select(F.col("patch_id").alias("patch_2"), code, F.lit(0).alias("a"), F.col("n").alias("b")), "patch_2")
    both = a.unionByName(b).groupBy("patch_1", "patch_2", code).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = both.groupBy("patch_1", "patch_2").agg((F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum(F.col("a") + F.col("b"))).alias("dissimilarity"))
    of = lambda k: centre.select(F.col("patch_id").alias(f"patch_{k}"), F.col("cx").alias(f"x{k}"), F.col("cy").alias(f"y{k}"))
    joined = out.join(of(1), "patch_1").join(of(2), "patch_2")
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    return joined.select("patch_1", "patch_2", "dissimilarity", F.sqrt(dx * dx + dy * dy).alias("distance"))


def alignment_order(cells: DataFrame, tile: float, image: str = "image_id", angle: str = "orientation") -> DataFrame:
    """Larger eigenvalue of the mean of (3 n_i n_j' - 1) / 2 over all pairs of a tile's cells.

    The mean over pairs factorises into the mean direction, so one grouping does.
    """
    g = cells.groupBy(image, F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    a, b, o = 1.5 * F.col("c") * F.col("c") - 0.5, 1.5 * F.col("s") * F.col("s") - 0.5, 1.5 * F.col("c") * F.col("s") - 0.5
    return g.select(image, "tx", "ty", ((a + b) / 2 + F.sqrt((a - b) * (a - b) / 4 + o * o)).alias("order"))


def background_ratio(pixels: DataFrame, images: DataFrame, v: str = "v", mask: str = "mask", channels: int = 32, image: str = "image_id", key: str = "experiment", ts: str = "ts", flag: str = "flag") -> DataFrame:
    """The factor that background_factor starts from: an image's background level over that of the image with flag 1 nearest in time.

    The level is the mean, where it is above 0, of the largest of the leading channels of pixels
    with mask 1. Flagged images have factor 1; it is null where no image of the experiment is flagged.
    """
    top = F.array_max(F.slice(v, 1, channels)) * F.col(mask)
    level = pixels.groupBy(image).agg(F.avg(F.when(top > 0, top)).alias("level"))
    near = J.nearest_flagged(images, key, ts, flag, image).join(level, image, "left")
    near = near.join(level.select(F.col(image).alias("nearest_id"), F.col("level").alias("nearest_level")), "nearest_id", "left")
    return near.select(image, "nearest_id", F.when(F.col(flag) == 1, 1.0).otherwise(F.col("level") / F.col("nearest_level")).alias("factor"))


def background_factor(mean: Column, background: Column, factor: Column, step: float = 0.01, floor: float = 0.005) -> Column:
    """factor lowered in steps until no channel of mean - factor * background is below -floor."""
    excess = F.zip_with(mean, background, lambda m, b: F.when(b > 0, (factor * b - m - floor) / b))
    worst = F.coalesce(F.array_max(F.filter(excess, lambda x: x.isNotNull())), F.lit(0.0))
    return factor - step * F.greatest(F.lit(0), F.ceil(F.round(worst / step, 9)))


def remove_background(pixels: DataFrame, images: DataFrame, v: str = "v", mask: str = "mask", channels: int = 32, image: str = "image_id", key: str = "experiment", ts: str = "ts", flag: str = "flag") -> DataFrame:
    """pixels with the background taken off the leading channels, and the factor used.

    The background of an image is the mean spectrum of the flagged image of its experiment that is
    nearest in time, over pixels with mask 1. Its factor starts at background_ratio and is lowered
    until the image's own mean stays above the floor in every leading channel. Images of experiments
    without a flagged one stay as they are, with a null factor.
    """
    ratio = background_ratio(pixels, images, v, mask, channels, image, key, ts, flag).withColumnRenamed("factor", "start")
    means = stored(mean_array(pixels.where(F.col(mask) == 1), [image], v), "means")
    own = means.select(image, F.col(v).alias("__mean"))
    background = means.select(F.col(image).alias("nearest_id"), F.col(v).alias("__background"))
    leading = lambda c: F.slice(c, 1, channels)
    factors = ratio.join(own, image).join(background, "nearest_id")
    factors = factors.select(image, "__background", background_factor(leading("__mean"), leading("__background"), F.col("start")).alias("factor"))
    # one row per image: Spark splits a large image, as the left side of a left join
    joined = pixels.join(factors, image, "left")
    return joined.withColumn(v, F.when(F.col("factor").isNull(), F.col(v)).otherwise(S.subtract_background(v, "__background", "factor", channels))).drop("__background")


def average_frames(pixels: DataFrame, value: str = "v", frame: str | None = None) -> DataFrame:
    """Mean of each place over frames, divided by the largest mean.

    With frame, the numbers of a place (held together) are added in the order of its frames: the
    same mean to the last bit on every run, where sums in any order differ in it.
    """
    mean = pixels.groupBy("x", "y")
    if frame is None:
        mean = mean.agg(F.avg(value).alias("m"))
    else:
        rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("at"), F.col(value).cast("double").alias("v")))))
        total = F.aggregate("rows", F.lit(0.0), lambda sum, row: sum + row["v"])
        mean = mean.agg(rows.alias("rows")).select("x", "y", F.when(F.size("rows") > 0, total / F.size("rows")).alias("m"))
    return mean.crossJoin(F.broadcast(mean.agg(F.max("m").alias("top")))).select("x", "y", (F.col("m") / F.col("top")).alias("calibration"))


def flat_field(pixels: DataFrame, calibration: DataFrame, v: str, channels: int) -> DataFrame:
    """The leading channels of each pixel's spectrum divided by the calibration of its place."""
    joined = pixels.join(calibration, ["x", "y"])
    fixed = F.transform(F.slice(v, 1, channels), lambda s: s / F.col("calibration"))
    return joined.withColumn(v, F.concat(fixed, F.slice(v, channels + 1, F.greatest(F.size(v) - channels, F.lit(0))))).drop("calibration")


def consensus(aligned: DataFrame, key: str, seq: str, min_members: int = 1) -> DataFrame:
    """The commonest letter at every place of a group's aligned sequences (ties: the smallest letter)."""
    long = aligned.select(key, F.posexplode(F.split(seq, "")).alias("k", "base")).groupBy(key, "k", "base").agg(F.count("*").alias("n"))
    best = long.groupBy(key, "k").agg(F.min(F.struct((-F.col("n")).alias("less"), "base")).alias("b"))
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b.base"))), lambda s: s["base"]), "").alias("consensus"))


def degree(adjacency: DataFrame, keys: list[str], a: str = "code_1", b: str = "code_2", n: str = "n") -> DataFrame:
    """Weighted degree of each class: its row sum without the diagonal."""
    return adjacency.groupBy(*keys, F.col(a).alias("code")).agg(F.sum(F.when(F.col(a) != F.col(b), F.col(n)).otherwise(0)).alias("degree"))


def diff_adjacency(adjacency: DataFrame, group: str, groups: tuple, value: str = "n") -> DataFrame:
    """log10 of the ratio of a pair's means in two groups; a ratio that is not finite becomes 0."""
    of = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    means = adjacency.groupBy("code_1", "code_2").agg(of(groups[0]).alias("m1"), of(groups[1]).alias("m2"))
    ratio = F.when((F.col("m1") > 0) & (F.col("m2") > 0), F.log10(F.col("m1") / F.col("m2"))).otherwise(0.0)
    return means.select("code_1", "code_2", ratio.alias("log_ratio"))


def present_everywhere(df: DataFrame, pair: list[str], time: str) -> DataFrame:
    """Pairs that occur at every time point."""
    times = df.agg(F.count_distinct(time).alias("__times"))
    return df.groupBy(*pair).agg(F.count_distinct(time).alias("__n")).join(F.broadcast(times), F.col("__n") == F.col("__times")).select(*pair)
