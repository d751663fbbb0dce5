"""Deletes, compaction, retention and admission."""

from __future__ import annotations

import fnmatch
import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compiler import Context, condition, time_bounds
from ..plans.parser import parse
from ..schema import quoted, severity
from ..sources.io import PLAIN_FILES, dealt, drop_trace_shaped, promote


@dataclass(frozen=True)
class Tombstone:
    """Rows of [start, end] that a query matches are deleted; an empty query or * matches all.  A query that does not parse raises."""

    query: str
    start: datetime
    end: datetime
    mode: str = "hide"

    def matches(self, df: DataFrame) -> Column:
        inside = time_bounds(df, self.start, self.end)
        if self.query.strip() in ("", "*"):
            return F.coalesce(inside, F.lit(False))
        return F.coalesce(inside & condition(df, parse(self.query).filter, Context(df)), F.lit(False))


def visible(df: DataFrame, tombstones: list[Tombstone]) -> DataFrame:
    """Rows that no tombstone matches."""
    for t in tombstones:
        df = df.filter(~t.matches(df))
    return df


def rewrite(spark: SparkSession, source: str, target: str, tombstones: list[Tombstone]) -> DataFrame:
    """Write what is left of a table to a new place; the caller swaps the two, so readers never see half of it."""
    df = spark.read.parquet(source)
    parts = [c for c in ("dt", "hour") if c in df.columns]
    out = visible(df, tombstones).write.mode("errorifexists").option("compression", "zstd").options(**PLAIN_FILES)
    (out.partitionBy(*parts) if parts else out).parquet(target)
    return spark.read.parquet(target)


def estimate(files: DataFrame, tombstone: Tombstone, klass: Column) -> DataFrame:
    """class, files, rows, bytes that a delete touches."""
    hit = files.filter((F.col("max_time") >= tombstone.start) & (F.col("min_time") <= tombstone.end))
    return hit.groupBy(klass.alias("class")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def rewrites_due(files: DataFrame, tombstones: list[tuple[Tombstone, datetime]], klass: Column, classes: list[str], delay_seconds: float, now: datetime) -> DataFrame:
    """Files that permanent deletes older than the delay touch, in storage classes that may be rewritten."""
    touched = F.lit(False)
    for t, made in tombstones:
        if t.mode != "hide" and (now - made).total_seconds() >= delay_seconds:
            touched = touched | ((F.col("max_time") >= t.start) & (F.col("min_time") <= t.end))
    return files.filter(touched & klass.isin(classes))


def coverage(tombstones: list[Tombstone], start: datetime, end: datetime) -> float:
    """Share of [start, end] that tombstones cover; overlapping ones count once."""
    spans = sorted((max(t.start, start), min(t.end, end)) for t in tombstones if t.end > start and t.start < end)
    covered, upto = 0.0, start
    for a, b in spans:
        a = max(a, upto)
        if b > a:
            covered += (b - a).total_seconds()
            upto = b
    whole = (end - start).total_seconds()
    return min(1.0, covered / whole) if whole > 0 else 0.0


def compact(df: DataFrame, promoted: list[str] | None = None) -> DataFrame:
    """Rows of small files as one large file has them: span-shaped rows dropped, levels filled in, columns healed, sorted."""
    out = drop_trace_shaped(df)
    if promoted:
        out = promote(out, "log.attributes", promoted)
    level = severity(F.col("severity_text"), F.col("severity_number"))
    out = out.select(*[level.alias(c) if c == "severity_text" else F.col(quoted(c)) for c in out.columns])
    return out.sortWithinPartitions("timestamp_unix_nano", quoted("service.name"))


def compact_spans(df: DataFrame, promoted: list[str] | None = None) -> DataFrame:
    """Span rows of small files as one large file has them: columns healed, sorted by trace so that a trace lies together."""
    out = promote(df, "span.attributes", promoted) if promoted else df
    return out.sortWithinPartitions("trace_id", "timestamp_unix_nano", "span_id")


def compact_table(spark: SparkSession, source: str, target: str, promoted: list[str] | None = None, spans: bool = False, files_per_hour: int = 1, level: int = 3) -> None:
    """Rewrite a table with `files_per_hour` files an hour (rows are dealt to them by trace or time), compressed at zstd's `level`; the caller swaps the two."""
    df = spark.read.parquet(source)
    by = "trace_id" if spans else "timestamp_unix_nano"
    df = dealt(df, "dt", "hour", F.pmod(F.xxhash64(by), F.lit(files_per_hour)))
    out = compact_spans(df, promoted) if spans else compact(df, promoted)
    out = out.sortWithinPartitions("dt", "hour", *(["trace_id"] if spans else []), "timestamp_unix_nano").write.mode("errorifexists").partitionBy("dt", "hour")
    out.options(**PLAIN_FILES).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(target)


def candidates(files: DataFrame, min_files: int = 2, target_bytes: int = 128 << 20, level: int = 0) -> DataFrame:
    """dt, hour, files, bytes, outputs: hours with several small files of a level."""
    small = files.filter((F.col("bytes") < target_bytes) & (F.col("level") == level))
    out = small.groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return out.filter(F.col("files") >= min_files).withColumn("outputs", F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes).cast("int")))


def eligible(files: DataFrame, now: datetime | Column, min_l0: int = 4, min_l1: int = 4, min_age_hours: float = 1, rollup_hours: float = 0) -> DataFrame:
    """dt, hour, level: hours to merge.  Level 0 goes first; level 1 merges from `min_l1` files, or from two once the hour is `rollup_hours` old (an hour at least; 0: never)."""
    at = F.to_timestamp(F.concat_ws(" ", "dt", F.lpad(F.col("hour").cast("string"), 2, "0")), "yyyy-MM-dd HH")
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at)) / 3600.0
    counted = files.groupBy("dt", "hour").agg(F.count_if(F.col("level") == 0).alias("l0"), F.count_if(F.col("level") == 1).alias("l1"))
    rolled = (F.col("l1") >= 2) & (age >= max(1.0, rollup_hours)) if rollup_hours > 0 else F.lit(False)
    level = F.when(F.col("l0") >= min_l0, 0).when((F.col("l1") >= min_l1) | rolled, 1)
    return counted.filter(age >= min_age_hours).select("dt", "hour", level.alias("level")).filter("level is not null")


def majority_schema(files: DataFrame) -> DataFrame:
    """For each hour the schema fingerprint most files have (ties: the least); others are left for later."""
    counted = files.groupBy("dt", "hour", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("dt", "hour").orderBy(F.desc("n"), "fingerprint")
    return counted.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")


#: Fixed values: (age in days below which it holds, zstd level); the last holds beyond.
ZSTD_BY_AGE = ((7, 3), (30, 7), (None, 17))


def zstd_level(age_hours: float, tiers=ZSTD_BY_AGE) -> int:
    """Harder compression for older files."""
    return next(level for days, level in tiers if days is None or age_hours < days * 24)


@dataclass(frozen=True)
class Retention:
    """Files whose labels match all patterns are kept for `days`."""

    days: float
    labels: tuple[tuple[str, str], ...] = ()


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\Z", "$").replace("(?s:", "(?s)(?:")


def _any_matches(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda v: F.rlike(v, F.lit(pattern)))


def expired(files: DataFrame, rules: list[Retention], now: datetime, default_days: float | None = None) -> DataFrame:
    """Files past the longest retention of the rules that match them; files that none matches are kept for `default_days`, for good if there is none.

    `label_values` maps each label of a file to the values that occur in it; a rule matches if one does.
    """
    keep = F.lit(None).cast("double")
    for r in rules:
        test = F.lit(True)
        for label, pattern in r.labels:
            test = test & F.coalesce(_any_matches(F.col("label_values")[label], _glob(pattern)), F.lit(False))
        keep = F.greatest(keep, F.when(test, F.lit(float(r.days))))
    keep = F.coalesce(keep, F.lit(default_days).cast("double"))
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("max_time").cast("timestamp"))) / 86400.0
    return files.filter(keep.isNotNull() & (age > keep))


def admitted(df: DataFrame, max_streams: int, stream: str = "_stream") -> DataFrame:
    """Rows of each tenant's first `max_streams` streams by first row; later streams are dropped whole."""
    first = df.groupBy("account_id", "project_id", F.col(quoted(stream)).alias("_s")).agg(F.min("_time").alias("_first"))
    rank = Window.partitionBy("account_id", "project_id").orderBy("_first", "_s")
    ok = first.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= max_streams).select(F.col("account_id").alias("_a"), F.col("project_id").alias("_p"), "_s")
    return df.join(ok, (F.col("account_id") == F.col("_a")) & (F.col("project_id") == F.col("_p")) & (F.col(quoted(stream)) == F.col("_s")), "left_semi")


def tenant_ids(aliases: dict[str, tuple[int, int]], header: str) -> tuple[int, int]:
    """A tenant by alias or as account:project; an empty header is tenant 0:0."""
    if not header:
        return 0, 0
    if header in aliases:
        return aliases[header]
    account, _, project = header.partition(":")
    if not account.isdigit() or project and not project.isdigit():
        raise ValueError(f"unknown tenant {header!r}")
    return int(account), int(project or 0)


def expected_files(bytes_: float, target: int = 128 << 20) -> int:
    return max(1, math.ceil(bytes_ / target))
