"""Tables written between the rounds of iterative operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    global _local
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="quiltgraph-")
    return _local


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def collect(spark: SparkSession) -> None:
    """The driver collects its garbage, whereupon Spark removes the shuffle files of jobs that are done.

    Those of the last job are let go only by a second collection, a moment after the first.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.2)
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and outlives executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    collect(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamps(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and time of change of files, as Hadoop's file systems tell them."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append((path, status.getLen(), status.getModificationTime()))
    return found


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Removes a table made by :func:`written`."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
