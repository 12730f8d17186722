"""Filters, windows and row-making steps of a probe design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from luminode.functions import scalars as S


def filter_properties(df: DataFrame, tm: str, gc: str, min_tm: float, max_tm: float, min_gc: float) -> DataFrame:
    return df.where(F.col(tm).between(min_tm, max_tm) & (F.col(gc) >= min_gc))


def filter_specific(df: DataFrame, min_rate: float, max_bitscore: float, max_tm: float, max_gc: float, rate: str = "on_target_rate", bitscore: str = "off_target_max_bitscore", tm: str = "off_target_max_tm", gc: str = "off_target_max_gc") -> DataFrame:
    """Rows on target above min_rate whose off-target extremes are all below their limits."""
    return df.where((F.col(rate) > min_rate) & (F.col(bitscore) < max_bitscore) & (F.col(tm) < max_tm) & (F.col(gc) < max_gc))


def add_flanks(df: DataFrame, key: str, seq: str, start: str, length: str, size: int = 3) -> DataFrame:
    """Distinct combinations of flanks per probe, and the reversed probe between them."""
    left, right = S.flank(seq, start, length, size)
    out = df.withColumns({"left_flank": left, "right_flank": right})
    spaced = F.concat("left_flank", F.reverse(F.substring(F.col(seq), F.col(start) + 1, F.col(length))), "right_flank")
    return out.withColumn("spaced", spaced).select(key, "left_flank", "right_flank", "spaced").distinct()


def window_flanks(df: DataFrame, key: str, seq: str, length: int = 20, size: int = 3) -> DataFrame:
    """add_flanks of all windows of `length` letters, laid end to end from the first letter.

    Windows and what stands right of them are cut in one pass, and a window's row holds its own letters
    only: add_flanks walks to each start and copies the whole sequence, the square of its length.
    """
    cut = F.lit(f"(?s)(?<=(\\A.{{0,{max(size - 1, 0)}}}|.{{{size}}})).{{{length}}}(?=(.{{0,{size}}}))")
    parts = [F.regexp_extract_all(seq, cut, F.lit(group)).alias(name) for group, name in ((1, "left_flank"), (2, "right_flank"), (0, "own"))]
    each = df.select(key, F.inline(F.arrays_zip(*parts)))
    return each.select(key, "left_flank", "right_flank", F.concat("left_flank", F.reverse("own"), "right_flank").alias("spaced")).distinct()


def replicate(df: DataFrame, copies: Column) -> DataFrame:
    """Each row as many times as `copies` says, numbered from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def candidates(seqs: DataFrame, key: str, seq: str, sizes: tuple[int, ...] = (18, 19, 20, 21, 22, 23), min_tm: float = 50, max_tm: float = 70, min_gc: int = 0, best_tm: float = 60, best_size: int = 20, include: tuple[int, int] | None = None) -> DataFrame:
    """All windows of the given sizes without N, within temperature and GC limits.

    include bounds the 0-based positions used. quality is |tm - best_tm| + |size - best_size|; lower is better.
    """
    low = F.lit(include[0] if include else 0)
    high = F.least(F.length(seq), F.lit(include[1])) if include else F.length(seq)
    rows = seqs.select(key, seq, F.explode(F.array(*map(F.lit, sizes))).alias("ln")).where(F.col("ln") <= high - low)
    rows = rows.select(key, seq, "ln", F.explode(F.sequence(low, high - F.col("ln"))).alias("p_start"))
    rows = rows.select(key, "p_start", "ln", F.substring(F.col(seq), F.col("p_start") + 1, F.col("ln")).alias("seq"))
    rows = rows.where(~F.col("seq").contains("N")).withColumns({"gc": S.gc_count("seq"), "tm": S.melting_temperature("seq")})
    rows = filter_properties(rows, "tm", "gc", min_tm, max_tm, min_gc)
    return rows.withColumn("quality", F.abs(F.col("tm") - best_tm) + F.abs(F.col("ln") - best_size))


def quality_filter(df: DataFrame, max_distance, min_cells: int, image: str = "image_id", distance: str = "centroid_distance") -> DataFrame:
    """Cells of small centroid distance, of images with at least min_cells cells (counted before)."""
    n = F.count("*").over(Window.partitionBy(image))
    return df.withColumn("n_cells", n).where((F.col("n_cells") >= min_cells) & (F.col(distance) < max_distance))


def assemble(oligos: DataFrame, readouts: DataFrame, forward: str, reverse: str, filler: str) -> DataFrame:
    """Full oligos: primer, readout of the code's first bit, target, readout of its last bit, primer.

    oligos: probe_id, code (one or two set bits), seq. readouts: bit (1-based), readout; one row
    per bit. A one-bit code has the filler in place of the second readout. Targets with N go.
    """
    bits = F.filter(F.transform(F.split("code", ""), lambda b, i: F.when(b == "1", i + 1)), lambda i: i.isNotNull())
    rows = oligos.where(~F.col("seq").contains("N")).withColumns({"bit_1": F.try_element_at(bits, F.lit(1)), "bit_2": F.try_element_at(bits, F.lit(2))})
    # the readout table has one row per bit of a code: it goes to every executor
    one = F.broadcast(readouts.select(F.col("bit").alias("bit_1"), F.col("readout").alias("readout_1")))
    two = F.broadcast(readouts.select(F.col("bit").alias("bit_2"), F.col("readout").alias("readout_2")))
    rows = rows.join(one, "bit_1").join(two, "bit_2", "left")
    return rows.withColumn("full", F.concat(F.lit(forward), "readout_1", F.col("seq"), F.coalesce("readout_2", F.lit(filler)), F.lit(reverse)))


def wrap_blocking(df: DataFrame, forward: str, reverse: str, fillers: dict[int, str], longest: str) -> DataFrame:
    """Blocking oligos between primers, filled up by a sequence that depends on their length."""
    return df.withColumn("full", F.concat(F.lit(forward), "seq", S.filler_for(F.length("seq"), fillers, longest), F.lit(reverse)))
