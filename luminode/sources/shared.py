"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where none is set, on one machine only."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths named so far in this process.
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _named.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _named[-1]


def drop_stored(spark: SparkSession) -> int:
    """Deletes all tables that were stored so far, and gives their number; results that read them must be saved before."""
    conf, path, deleted = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path, 0
    while _named:
        at = path(_named.pop())
        deleted += bool(at.getFileSystem(conf).delete(at, True))
    return deleted


def stored(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back; its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
