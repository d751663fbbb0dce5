"""Names and values of fields, streams and tenants, always with true hit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAPS, quoted, resolve


def plain_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]


def field_names(df: DataFrame) -> DataFrame:
    """name, hits: rows in which each field is not empty; attribute keys count as fields."""
    names = plain_fields(df)
    counts = df.agg(*[F.count(F.when(resolve(df, n).text != "", 1)).alias(f"c{k}") for k, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{k}").alias("hits")) for k, n in enumerate(names)])
    out = counts.select(F.inline(pairs)) if names else None
    for m in (m for m in MAPS if m in df.columns):
        keys = df.select(F.explode(F.map_keys(F.map_filter(quoted_map(m), lambda k, v: F.coalesce(v, F.lit("")) != ""))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
        out = keys if out is None else out.unionByName(keys)
    return out.groupBy("name").agg(F.sum("hits").alias("hits")).filter("hits > 0")


def quoted_map(name: str):
    return F.col(quoted(name))


def field_values(df: DataFrame, field: str, limit: int | None = None, contains: str = "") -> DataFrame:
    """value, hits; a limit keeps the most frequent after all are counted."""
    rows = df.select(resolve(df, field).text.alias("value")).filter("value <> ''")
    rows = rows.filter(F.contains("value", F.lit(contains))) if contains else rows
    out = rows.groupBy("value").agg(F.count(F.lit(1)).alias("hits"))
    return out.orderBy(F.desc("hits"), "value").limit(limit) if limit is not None else out


def facets(df: DataFrame, n: int = 10, fields: list[str] | None = None, max_values: int | None = None) -> DataFrame:
    """field_name, field_value, hits: the n most frequent values of each field, ties by value."""
    names = fields or [f for f in plain_fields(df) if not isinstance(df.schema[f].dataType, (T.TimestampType, T.TimestampNTZType))]
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), resolve(df, f).text.alias("field_value")) for f in names])
    counted = df.select(F.inline(pairs)).filter("field_value <> ''").groupBy("field_name", "field_value").agg(F.count(F.lit(1)).alias("hits"))
    rank = Window.partitionBy("field_name").orderBy(F.desc("hits"), "field_value")
    if max_values is not None:
        size = counted.groupBy("field_name").count().filter(F.col("count") <= max_values).select("field_name")
        counted = counted.join(size, "field_name", "left_semi")
    return counted.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= n).drop("_r")


def streams(df: DataFrame, limit: int | None = None) -> DataFrame:
    return field_values(df, "_stream", limit)


def stream_ids(df: DataFrame, limit: int | None = None) -> DataFrame:
    return field_values(df, "_stream_id", limit)


def stream_field_names(df: DataFrame) -> DataFrame:
    """Tags that occur in the streams' texts, with the rows that carry them."""
    tags = F.regexp_extract_all(F.col("_stream"), F.lit(r'([^{",=]+)="'), 1)
    return df.select(F.explode(F.array_distinct(tags)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("hits"))


def stream_field_values(df: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    return field_values(df, tag, limit)


def tenants(df: DataFrame) -> DataFrame:
    return df.select("account_id", "project_id").distinct()
