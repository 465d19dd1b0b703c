"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders handed out by this process.
_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; driver and executors all see it.

    Only where that setting is missing and the master is local, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    _FOLDERS.append(f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the tables that cut() wrote in this process; for the end of a job, as tables read from them are gone then. Returns how many there were."""
    n = 0
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it again: what follows survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
