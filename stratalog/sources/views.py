"""Logs, spans and file metadata as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    return e.select(
        "event_id",
        F.col("ts").alias("_time"),
        F.col("event_type").alias("level"),
        service.alias("service.name"),
        F.concat(F.col("event_type"), F.lit(" k="), k).alias("_msg"),
        F.col("value").alias("duration"),
        F.floor(F.col("event_id") / 4).cast("long").alias("trace_id"),
        "user_id",
        F.concat(F.lit("10."), (F.col("user_id") % 4).cast("string"), F.lit(".0."), (F.col("event_id") % 256).cast("string")).alias("ip"),
        F.concat(F.lit('{level="'), F.col("event_type"), F.lit('",service.name="'), service, F.lit('"}')).alias("_stream"),
        (F.col("user_id") % 3).cast("long").alias("account_id"),
        F.lit(0).cast("long").alias("project_id"),
        "props",
        F.from_json("props", "map<string,string>").alias("log.attributes"),
    )


def blank_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose level is missing on every third row."""
    out = logs(spark, sf_dir)
    level = F.when(F.col("event_id") % 3 != 0, F.col("level"))
    return out.select(*[level.alias("level") if c == "level" else F.col(f"`{c}`") for c in out.columns])


def docs_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per document: full texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("_msg"), F.col("source").alias("service.name"), F.col("lang").alias("level"), "n_chars")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per event, four to a trace, each the child of the one before."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.floor(i / 4).cast("long").alias("trace_id"),
        i.alias("span_id"),
        F.when(i % 4 != 0, i - 1).alias("parent_span_id"),
        F.col("event_type").alias("name"),
        F.when(i % 2 == 0, F.lit(3)).otherwise(F.lit(2)).alias("kind"),
        F.when(F.col("event_type") == "error", F.lit(2)).otherwise(F.lit(0)).alias("status_code"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service.name"),
        F.col("ts").alias("_time"),
        F.round(F.col("value") * 1_000_000).cast("long").alias("duration"),
        F.from_json("props", "map<string,string>").alias("span.attributes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of an hour's file: rows, times, bytes, and label counts."""
    return manifest(logs(spark, sf_dir), ["level", "service.name"])


def manifest(df: DataFrame, labels: list[str], cap: int = 100) -> DataFrame:
    """One row per (dt, hour): row count, first and last time, text bytes, and for each label its values' counts.

    A label with more than `cap` values in a file has no counts there.
    """
    hour = df.select(
        F.date_format("_time", "yyyy-MM-dd").alias("dt"),
        F.hour("_time").alias("hour"),
        "_time",
        F.octet_length("_msg").cast("long").alias("_bytes"),
        *[F.col(f"`{name}`").alias(name) for name in labels],
    )
    base = hour.groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("rows"), F.min("_time").alias("min_time"), F.max("_time").alias("max_time"), F.sum("_bytes").alias("bytes"))
    pairs = F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"`{name}`").alias("value")) for name in labels])
    counts = hour.select("dt", "hour", F.inline(pairs)).groupBy("dt", "hour", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.filter("value is not null").groupBy("dt", "hour", "label").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("m")).filter(F.size("m") <= cap)
    return base.join(maps.groupBy("dt", "hour").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("labels")), ["dt", "hour"], "left")
