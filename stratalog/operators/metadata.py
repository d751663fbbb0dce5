"""Answers from file metadata, and statistics over it."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import time_bounds
from ..schema import resolve


def files_in_range(files: DataFrame, start=None, end=None) -> DataFrame:
    """Files whose times overlap [start, end]."""
    out = files.filter(F.col("max_time") >= start) if start is not None else files
    return out.filter(F.col("min_time") <= end) if end is not None else out


def has_data(df: DataFrame, start, end) -> bool:
    """Whether any row lies in [start, end]; exact, gaps included."""
    return not df.filter(_inside(df, start, end)).isEmpty()


def _inside(rows: DataFrame, start, end) -> Column:
    aware = lambda at: at if not isinstance(at, datetime) or at.tzinfo else at.replace(tzinfo=UTC)
    return time_bounds(rows, aware(start), aware(end))


def _scanned(files: DataFrame, rows: DataFrame, start, end) -> DataFrame:
    """Rows in [start, end] of some files: by path (and the partitions it lies in) where files have one, else by hour."""
    scan = rows.filter(_inside(rows, start, end))
    if "path" in files.columns:
        return scan.withColumn("path", F.col("_metadata.file_path")).join(files.select("dt", "hour", "path"), ["dt", "hour", "path"], "left_semi")
    scan = scan.withColumn("dt", F.date_format("_time", "yyyy-MM-dd")).withColumn("hour", F.hour("_time"))
    return scan.join(files.select("dt", "hour"), ["dt", "hour"], "left_semi")


def count_by(files: DataFrame, rows: DataFrame, label: str, start, end) -> DataFrame:
    """label, n over [start, end]: files that lie inside are answered by their counts, rows of the others are scanned.

    Files whose counts were left out for too many values are scanned too.
    """
    inside = (F.col("min_time") >= start) & (F.col("max_time") <= end) & F.col("labels").isNotNull() & F.map_contains_key("labels", F.lit(label))
    hit = files_in_range(files, start, end)
    known = hit.filter(inside).select(F.explode(F.col("labels")[label]).alias(label, "n"))
    scan = _scanned(hit.filter(~F.coalesce(inside, F.lit(False))), rows, start, end)
    scanned = scan.groupBy(resolve(rows, label).column.alias(label)).agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(scanned).groupBy(f"`{label}`").agg(F.sum("n").alias("n"))


def count_rows(files: DataFrame, rows: DataFrame, start, end) -> DataFrame:
    """n: rows in [start, end], whole files from metadata, files on the border scanned."""
    hit = files_in_range(files, start, end)
    inside = (F.col("min_time") >= start) & (F.col("max_time") <= end)
    known = hit.filter(inside).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    scanned = _scanned(hit.filter(~inside), rows, start, end).agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(scanned).agg(F.sum("n").alias("n"))


def overview(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"))


def partitions(files: DataFrame) -> DataFrame:
    return files.groupBy("dt").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def ingestion(files: DataFrame, period: str = "day") -> DataFrame:
    """Rows and bytes by hour, day or month of the first row."""
    return files.groupBy(F.date_trunc(period, "min_time").alias("period")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def tenants(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account_id", "project_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("_msg").cast("long")).alias("bytes"), F.min("_time").alias("min_time"), F.max("_time").alias("max_time"))


def breakdown(rows: DataFrame, label: str) -> DataFrame:
    """value, rows, bytes: of each value of a label; bytes are those of its messages."""
    return rows.groupBy(resolve(rows, label).text.alias("value")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("_msg").cast("long")).alias("bytes"))


def cardinality(rows: DataFrame, fields: list[str], exact: bool = False) -> DataFrame:
    """field, distinct: by HyperLogLog sketches, or exactly."""
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, 0.01)
    counts = rows.agg(*[count(F.nullif(resolve(rows, f).text, F.lit(""))).alias(f"c{k}") for k, f in enumerate(fields)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{k}").alias("distinct")) for k, f in enumerate(fields)])))


def sketches(rows: DataFrame, by: list[str], field: str) -> DataFrame:
    """A mergeable distinct-count sketch for each group."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(resolve(rows, field).text, F.lit(14)).alias("sketch"))


def merged_estimate(sketch_rows: DataFrame) -> DataFrame:
    return sketch_rows.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def compression(files: DataFrame, raw: str = "raw_bytes", stored: str = "bytes", by: tuple[str, ...] = ()) -> DataFrame:
    agg = [F.sum(raw).alias("raw_bytes"), F.sum(stored).alias("stored_bytes"), (F.sum(raw) / F.sum(stored)).alias("ratio")]
    return files.groupBy(*by).agg(*agg) if by else files.agg(*agg)


def storage_class(age_days: Column, rules: list[tuple[int, str]]) -> Column:
    """The class of a file by age: the last rule whose day is reached; the first rule starts at 0."""
    out = F.lit(rules[0][1])
    for day, name in sorted(rules):
        out = F.when(age_days >= day, F.lit(name)).otherwise(out)
    return out


def cost(files: DataFrame, prices: dict[str, float], now, rules: list[tuple[int, str]]) -> DataFrame:
    """class, bytes, monthly_cost, saved (against the first class), by storage class of the files' age."""
    age = F.date_diff(F.lit(now).cast("date"), F.col("max_time").cast("date"))
    gb = F.col("bytes") / float(1 << 30)
    price = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    grouped = files.groupBy(storage_class(age, rules).alias("class")).agg(F.sum("bytes").alias("bytes"))
    return grouped.select("class", "bytes", (gb * price[F.col("class")]).alias("monthly_cost"), (gb * (F.lit(prices[rules[0][1]]) - price[F.col("class")])).alias("saved"))


def parity(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows counted by metadata and by scan, and their difference in percent."""
    none = F.lit(0).cast("long")
    a = files.agg(F.coalesce(F.sum("rows"), none).alias("manifest"), none.alias("scanned"))
    b = rows.agg(none.alias("manifest"), F.count(F.lit(1)).alias("scanned"))
    both = a.unionByName(b).agg(F.sum("manifest").alias("manifest"), F.sum("scanned").alias("scanned"))
    return both.select("manifest", "scanned", F.when(F.col("scanned") == 0, F.lit(0.0)).otherwise(F.abs(F.col("manifest") - F.col("scanned")) * 100.0 / F.nullif(F.col("scanned"), F.lit(0))).alias("drift_percent"))


def catalog(rows: DataFrame, fields: list[str], max_values: int = 10_000) -> DataFrame:
    """dt, field, value, hits: the values of each day.  Fields with more distinct values than that are left out (ids belong in a search, not in a catalog)."""
    day = F.date_format("_time", "yyyy-MM-dd").alias("dt")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), resolve(rows, f).text.alias("value")) for f in fields])
    counted = rows.select(day, F.inline(pairs)).filter("value <> ''").groupBy("dt", "field", "value").agg(F.count(F.lit(1)).alias("hits"))
    few = counted.groupBy("field").agg(F.count_distinct("value").alias("n")).filter(F.col("n") <= max_values).select("field")
    return counted.join(few, "field", "left_semi").select("dt", "field", "value", "hits")


def catalog_values(catalog_rows: DataFrame, field: str, contains: str = "", limit: int | None = None) -> DataFrame:
    """value, hits over all days of a catalog."""
    own = catalog_rows.filter(F.col("field") == field)
    own = own.filter(F.contains("value", F.lit(contains))) if contains else own
    out = own.groupBy("value").agg(F.sum("hits").alias("hits"))
    return out.orderBy(F.desc("hits"), "value").limit(limit) if limit is not None else out


def files_with_label(files: DataFrame, catalog_rows: DataFrame, field: str, value: str) -> DataFrame:
    """Files of days on which a value occurs: a semi join with the catalog."""
    days = catalog_rows.filter((F.col("field") == field) & (F.col("value") == value)).select("dt").distinct()
    return files.join(days, "dt", "left_semi")


def files_containing(files: DataFrame, low: str, high: str, value) -> DataFrame:
    """Files whose [low, high] columns may contain a value."""
    return files.filter(F.lit(value).between(F.col(low), F.col(high)))


def field_bytes(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, bytes: of each field's text, before compression."""
    sums = rows.agg(*[F.coalesce(F.sum(F.octet_length(resolve(rows, f).text).cast("long")), F.lit(0)).alias(f"c{k}") for k, f in enumerate(fields)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{k}").alias("bytes")) for k, f in enumerate(fields)])))


def compaction_stats(files: DataFrame) -> DataFrame:
    """level, files, rows, bytes, mean_bytes."""
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.avg("bytes").alias("mean_bytes"))
