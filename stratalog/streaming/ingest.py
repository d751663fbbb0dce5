"""Structured Streaming: ingest into the partitioned table, windows over time, service-graph edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.traces import graph_halves
from ..sources.io import log_rows


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines from a folder as they arrive."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def ingest(lines: DataFrame, root: str, checkpoint: str, every: str | None = None, stream_fields: tuple[str, ...] = ("service.name",), future: str = "2 days") -> StreamingQuery:
    """Write log rows under dt=/hour= exactly once; late rows are kept, rows too far in the future are not.

    Without `every` it takes what is there and ends.
    """
    rows = log_rows(lines, stream_fields)
    at = F.timestamp_micros(F.floor(F.col("timestamp_unix_nano") / 1000).cast("long"))
    rows = rows.withColumn("dt", F.date_format(at, "yyyy-MM-dd")).withColumn("hour", F.hour(at)).filter(at <= F.current_timestamp() + F.expr(f"interval {future}"))
    out = rows.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("dt", "hour").outputMode("append")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def distinct_rows(rows: DataFrame, keys: list[str], time: str = "_time", lateness: str = "2 minutes") -> DataFrame:
    """Rows without repeats of their keys within the lateness."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, step: str, by: tuple[str, ...] = (), time: str = "_time", lateness: str | None = None) -> DataFrame:
    """_time (window start), by, hits; with a lateness, windows close and late rows are left out."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, lateness) if lateness else rows
    grouped = rows.groupBy(F.window(time, step), *[F.col(f"`{b}`") for b in by]).agg(F.count(F.lit(1)).alias("hits"))
    return grouped.select(F.col("window.start").alias("_time"), *[f"`{b}`" for b in by], "hits")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """The result of a stream over what is there now, as a table in memory."""
    out = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    out = out.option("checkpointLocation", checkpoint) if checkpoint else out
    out.start().awaitTermination()
    return df.sparkSession.table(name)


def graph_task(spans: DataFrame, root: str, checkpoint: str, lookbehind: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Append each micro-batch's service-graph edges, marked with the batch, to a table.

    The two spans of an edge may come in any batches, as long as their times
    lie within `lookbehind` of each other; state older than that is dropped.
    """
    child, parent = graph_halves(spans)
    child = child.withColumnRenamed("at", "child_at").withWatermark("child_at", lookbehind)
    parent = parent.select(F.col("id").alias("own"), "parent", F.col("at").alias("parent_at")).withWatermark("parent_at", lookbehind)
    near = F.expr(f"child_at >= parent_at - interval {lookbehind} and child_at <= parent_at + interval {lookbehind}")
    edges = child.join(parent, (F.col("id") == F.col("own")) & near & (F.col("parent") != F.col("child"))).select("parent", "child")

    def write(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("callCount")).withColumn("batch", F.lit(number))
        counted.write.mode("overwrite").parquet(f"{root}/batch={number}")  # the same batch again replaces itself

    out = edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
