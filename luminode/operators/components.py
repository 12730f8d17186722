"""Connected components of an undirected graph, as Spark joins: large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.sources.shared import stored


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of long ids -> (id, component): every id with a link and the smallest id reachable.

    Each round links neighbours to the smallest id near them, first the larger ones, then the
    smaller ones; rounds are logarithmic in the longest chain. A round that finds nothing but stars
    (no id is both linked down and linked to) is the last. Every round is written to the shared
    folder, so lost executors cost one round. Loops and repeated links do no harm.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    for _ in range(max_rounds):
        both = _mirrored(now)
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        down = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(down.union(root.select("a", F.col("m").alias("b"))).distinct(), "links")
        # stars only: no centre is linked down, and no id has two centres
        if now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
