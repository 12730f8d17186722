"""Running values over groups of any size: a key's rows are cut into ranges, whose boundary values are carried on.

A window over a key puts all its rows into one task. Here rows are dealt by ranges of key and order,
so that a key with very many rows lies in many parts; what a part hands on to the next ones (a sum, a
count, the last flagged row) is one row per key and part; windows run within parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luminode.sources.shared import stored

PART = "__part"


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df, written in parts: a key's rows lie in consecutive parts, numbered by `__part`, in the given order."""
    return stored(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _handed(parts: DataFrame, keys: list[str], **values: tuple[Column, Column, bool]) -> DataFrame:
    """parts with, for each name, what the key's earlier (or later) parts hand on: (value of a part, how parts add up, from earlier ones)."""
    of_part = parts.groupBy(*keys, PART).agg(*[value.alias(name) for name, (value, _, _) in values.items()])
    along = Window.partitionBy(*keys).orderBy(PART)
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    handed = of_part.select(
        F.col(PART).alias("__at_part"),
        *[F.col(k).alias(f"__of_{n}") for n, k in enumerate(keys)],
        *[joined.over(before if back else after).alias(name) for name, (_, joined, back) in values.items()],
    )
    match = F.col(PART) == F.col("__at_part")
    for n, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__of_{n}"))
    return parts.join(handed, match, "left").drop("__at_part", *[f"__of_{n}" for n in range(len(keys))])


def nearest_flagged(df: DataFrame, key: str, ts: str, flag: str, id: str) -> DataFrame:
    """Each row with the id of the row of its key that has flag 1 and is nearest in time.

    Flagged rows join themselves; of equally near rows the earlier counts; rows of keys without
    any flagged row have null.
    """
    parts = ranged(df, [key], [F.col(ts), F.col(id)])
    mark = F.when(F.col(flag) == 1, F.struct(F.col(ts).alias("t"), F.col(id).alias("i")))
    # the last flagged row is the largest of its part, the first the smallest
    rows = _handed(parts, [key], __back=(F.max(mark), F.max("__back"), True), __ahead=(F.min(mark), F.min("__ahead"), False))
    within = Window.partitionBy(key, PART).orderBy(ts, id)
    before = F.coalesce(F.last(mark, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "__back")
    after = F.coalesce(F.first(mark, ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing)), "__ahead")
    rows = rows.withColumns({"__before": before, "__after": after})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    back, ahead = micros(ts) - micros("__before.t"), micros("__after.t") - micros(ts)
    nearest = F.when(F.col("__before").isNull(), F.col("__after.i")).when(F.col("__after").isNull(), F.col("__before.i")).when(back <= ahead, F.col("__before.i")).otherwise(F.col("__after.i"))
    return rows.withColumn("nearest_id", nearest).drop("__before", "__after", "__back", "__ahead", PART)


def running(df: DataFrame, keys: list[str], order: list[Column], number: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df with the row's number in its key (from 1) and running sums (name: column) up to and with the row."""
    sums = sums or {}
    parts = ranged(df, keys, order)
    hand = {"__rows": (F.count("*"), F.sum("__rows"), True)} | {f"__sum_{n}": (F.sum(c), F.sum(f"__sum_{n}"), True) for n, c in sums.items()}
    rows = _handed(parts, keys, **hand)
    within = Window.partitionBy(*keys, PART).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    added = {number: F.row_number().over(within) + F.coalesce("__rows", F.lit(0))}
    for name, c in sums.items():
        here, carried = F.sum(c).over(upto), F.col(f"__sum_{name}")
        added[name] = F.when(here.isNull(), carried).when(carried.isNull(), here).otherwise(here + carried)
    return rows.withColumns(added).drop(*hand, PART)


def with_halo(df: DataFrame, keys: list[str], order: list[Column], number: str, reach: int, block: int = 4096) -> tuple[DataFrame, Column]:
    """Rows in blocks of a key (`__block`), each with the `reach` rows before and after it, and the column that tells a block's own rows.

    number has the row's number from 1; windows over (keys, block) by number see what they would over keys.
    """
    at = F.col(number) - 1
    own = F.floor(at / block)
    near = F.array_compact(F.array(own, F.when((at % block < reach) & (own > 0), own - 1), F.when(at % block >= block - reach, own + 1)))
    rows = running(df, keys, order, number).withColumn("__own", own)
    return rows.withColumn("__block", F.explode(near)), F.col("__block") == F.col("__own")
