"""Structured Streaming: new image tables are classified, and abundances run, as files arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import TimestampNTZType

from luminode.operators import joins as J
from luminode.operators import summaries
from luminode.sources.shared import new_path


def arrivals(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at path (a file or a folder): all in one batch, or so many a batch."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # a single file is only taken by a pattern; this one fits no other name
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def _run(spark: SparkSession, stream: DataFrame, mode: str, keep) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "progress"))
    writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def abundance_stream(events: DataFrame, keys: list[str], category: str, time: str | None = None, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Streaming counts of categories within keys: of all time, or of each window of a time column.

    A window closes once the latest time of earlier batches is `delay` past its end: its state is
    freed, and rows that come in a later batch than that are left out. Without a time column there
    is a state for every key and category. A time without zone is taken as UTC's.
    """
    if not time:
        return events.groupBy(*keys, category).agg(F.count("*").alias("n"))
    if isinstance(events.schema[time].dataType, TimestampNTZType):
        events = events.withColumn(time, F.concat(F.col(time).cast("string"), F.lit("Z")).cast("timestamp"))
    return events.withWatermark(time, delay).groupBy(F.window(time, window), *keys, category).agg(F.count("*").alias("n"))


def run_abundance(spark: SparkSession, path: str, keys: list[str], category: str, time: str | None = None, window: str = "1 day", delay: str = "1 day", files_per_batch: int | None = None) -> DataFrame:
    """Runs abundance_stream over all files at path; the last state of each group equals the batch result.

    With a time column the start of a group's window is in `window_start`.
    """
    out = new_path(spark, "abundance")
    events = arrivals(spark, path, files_per_batch)
    counts, groups = abundance_stream(events, keys, category, time, window, delay), [*keys, category]
    if time:
        start = F.col("window.start")
        if isinstance(events.schema[time].dataType, TimestampNTZType):
            start = F.convert_timezone(None, F.lit("UTC"), start.cast("timestamp_ntz"))
        counts, groups = counts.withColumn("window_start", start).drop("window"), ["window_start", *groups]

    def keep(batch: DataFrame, epoch: int) -> None:
        # a batch that is tried again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(spark, counts, "update", keep)
    return spark.read.parquet(out).groupBy(*groups).agg(F.max_by("n", "epoch").alias("n"))


def run_diversity(spark: SparkSession, path: str, keys: list[str], category: str, files_per_batch: int | None = None) -> DataFrame:
    """Diversity of the running counts of each key after every batch of files: a row per batch and key.

    Every batch is given all counts so far, so the rows of the last one equal the batch result.
    """
    out = new_path(spark, "diversity")

    def measure(batch: DataFrame, epoch: int) -> None:
        summaries.diversity(batch, keys).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(spark, abundance_stream(arrivals(spark, path, files_per_batch), keys, category), "complete", measure)
    return spark.read.parquet(out).withColumnRenamed("epoch", "batch")


class _Diversity(StatefulProcessor):
    """Per key: a count of each category, and the sums n, n ln n and n squared from which diversity follows."""

    def __init__(self, keys: list[str], idle: int | None):
        self.keys, self.idle = keys, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "category string", "n long")
        self.sums = handle.getValueState("sums", "n long, richness int, nlogn double, squares double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        n, richness, nlogn, squares = self.sums.get() if self.sums.exists() else (0, 0, 0.0, 0.0)
        came: dict[str, int] = {}
        latest = None
        for part in rows:
            for category, more in zip(part["category"], part["n"]):
                came[category] = came.get(category, 0) + int(more)
            if self.idle is not None:
                last = part["time"].max()
                latest = last if latest is None else max(latest, last)
        for category, more in sorted(came.items()):
            old = self.counts.getValue((category,))[0] if self.counts.containsKey((category,)) else 0
            new = old + more
            self.counts.updateValue((category,), (new,))
            n, richness, squares = n + more, richness + (old == 0), squares + new * new - old * old
            nlogn += new * math.log(new) - (old * math.log(old) if old else 0.0)
        self.sums.update((n, richness, nlogn, squares))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle)
        # a key with one category has no diversity, whatever the sums' last bits say
        shannon = math.log(n) - nlogn / n if richness > 1 else 0.0
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "n": [n], "richness": [richness], "shannon": [shannon], "inverse_simpson": [n * n / squares]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        self.counts.clear()
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


def _counted(events: DataFrame, keys: list[str], category: str, time: str | None) -> DataFrame:
    """Each task's counts of (keys, category), and the latest time: what a key receives does not grow with its rows."""
    columns = [F.col(k) for k in keys] + [F.col(category).cast("string").alias("category")] + ([F.col(time).cast("timestamp").alias("time")] if time else [])
    rows = events.where(F.col(category).isNotNull()).select(*columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch.append_column("n", pa.array(np.ones(batch.num_rows, np.int64)))])
            sums = table.group_by([*keys, "category"]).aggregate([("n", "sum")] + ([("time", "max")] if time else []))
            named = sums.rename_columns({"n_sum": "n"} | ({"time_max": "time"} if time else {})).select([*keys, "category", "n"] + (["time"] if time else []))
            yield from named.combine_chunks().to_batches()

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(count, f"{kinds}, category string, n long" + (", time timestamp" if time else ""))


def diversity_by_key(spark: SparkSession, path: str, keys: list[str], category: str, folder: str, time: str | None = None, idle: str | None = None, delay: str = "1 day", files_per_batch: int | None = None) -> DataFrame:
    """Running diversity of each key with a state of its own: a batch reads and writes the keys it holds only.

    folder keeps the progress and the results; a later call with the same folder goes on with the
    files that are new. Gives a row per batch and changed key: batch, keys, n, richness, shannon and
    inverse_simpson; last_of gives each key's last row. With a time column and `idle`, the state of a
    key is dropped once the stream's watermark (`delay` behind the latest time) is that long past its
    last event; should the key return, it starts anew. Rows with a null category do not count.
    """
    if (time is None) != (idle is None):
        raise ValueError("time and idle go together")
    events = arrivals(spark, path, files_per_batch)
    rows = _counted(events, keys, category, time)
    if time:
        rows = rows.withWatermark("time", delay)
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n long, richness int, shannon double, inverse_simpson double"
    state = rows.groupBy(*keys).transformWithStateInPandas(_Diversity(keys, idle_ms), schema, "Update", "EventTime" if time else "None")

    def keep(batch: DataFrame, epoch: int) -> None:
        # a batch that is tried again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={epoch}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress")
        writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{folder}/changes")


def last_of(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in values])


def classify_stream(spark: SparkSession, path: str, reference: DataFrame, metric, flags: Column, id: str = "vec_id", v: str = "v") -> DataFrame:
    """Gates and classifies spectra as their files arrive at path: code and distance of each, each file once.

    flags is the gate, a column over a spectrum v; spectra meet the references with equal flags.
    """
    out = new_path(spark, "classified")

    def classify(batch: DataFrame, epoch: int) -> None:
        J.nn_classify(batch, reference, metric, id).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(spark, arrivals(spark, path, 2).withColumn("flags", flags), "append", classify)
    return spark.read.parquet(out).drop("epoch")
