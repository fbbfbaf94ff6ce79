"""Tables written once to the folder that driver and executors share, and read back: lineage ends there."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Rows of a table that a task sorts or joins, where their number is known.
TASK_ROWS = 1 << 20
#: Spark then removes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a temporary folder if all runs in one process (tests), else an error, as executors
    that write to disks of their own would lose what they wrote without a word."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sievelight-"))
        return _OWN[0]
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sievelight-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back; the shuffles that made it are gone then, and lost executors cost only single tasks."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows, so that a task's memory does not grow with the table; None where one would hold them all, which is
    left to Spark."""
    return None if rows <= TASK_ROWS else max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """df dealt by columns to that many partitions, as it is for None."""
    return df if tasks is None else df.repartition(tasks, *by)


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more; what wasn't stored is passed over."""
    for t in tables:
        at = None if t is None else t.__dict__.get("_stored_at")
        if at:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
