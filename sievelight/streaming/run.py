"""Streams over stored tables, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: How many parts state is kept in.
_PARTS = "spark.sql.shuffle.partitions"


def run_available(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str, order: str | None = None, slice_rows: int = 100_000, key: str | None = None) -> DataFrame:
    """What a streaming operator makes of stored rows, run until all are read; results and progress lie in the shared folder.

    With order (a column), rows are stored in slices of about slice_rows by it, all rows of one value in the same slice, and a micro-batch
    reads one slice, the earliest first: however many rows a stream has, a task holds those of a slice. With key, what slices are counted
    by is the longest stream, so that many streams side by side don't make more micro-batches, and state is kept in no more parts than
    four a stream.
    """
    spark, parts = rows.sparkSession, None
    path = new_path(spark, name)
    if order is None:
        rows.write.parquet(f"{path}/rows")
        source = spark.readStream
    else:
        counts = [rows.count()] if key is None else [*rows.groupBy(key).count().agg(F.max("count"), F.count("*")).first()]
        parts = None if key is None else max(1, min(4 * counts[1], int(spark.conf.get(_PARTS))))
        rows.repartitionByRange(max(1, -(-(counts[0] or 0) // slice_rows)), order).sortWithinPartitions(order).write.parquet(f"{path}/rows")
        _in_turn(spark, f"{path}/rows")
        source = spark.readStream.option("maxFilesPerTrigger", 1)
    out = operator(source.schema(rows.schema).parquet(f"{path}/rows"))
    before = spark.conf.get(_PARTS)
    spark.conf.set(_PARTS, before if parts is None else str(parts))  # a running query keeps what it was started with
    try:
        query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PARTS, before)
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _in_turn(spark: SparkSession, path: str) -> None:
    """A file source reads by time of change: give the files of path times in the order of their partitions. A store that doesn't keep
    them can't be read in order, which is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    began = 1_000_000_000_000
    for k, file in enumerate(files):
        fs.setTimes(file, began + 1000 * k, -1)
        if fs.getFileStatus(file).getModificationTime() != began + 1000 * k:
            raise RuntimeError(f"{path}: this store does not keep times of change, so slices cannot be read in order")


def counted(verdicts: DataFrame, window: str = "60 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Live counts of a stream of verdicts (ts, verdict): a sliding window each slide; rows later than late are dropped."""
    return verdicts.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "verdict").agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), "verdict", "n")


def logged(stream: DataFrame, kind: str, path: str, progress: str, began_ms: int = 0):
    """A stream as JSON lines, each with its type, the time of day and the time since the session began."""
    now = F.unix_millis(F.current_timestamp())
    lines = stream.select(F.lit(kind).alias("type"), now.alias("wallMs"), (now - began_ms).alias("elapsedMs"), "*")
    return lines.writeStream.format("json").option("path", path).option("checkpointLocation", progress).outputMode("append")


def csv_log(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header in each file; commas in texts become semicolons."""
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    rows.withColumns({c: F.translate(c, ",", ";") for c in texts}).write.option("header", True).csv(path)
