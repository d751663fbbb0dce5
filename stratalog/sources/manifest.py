"""A manifest stored beside a table: a row for each file, and where its traces lie.

`refresh` describes the files that are new since the last call, by one read
of those files (of the whole table if half of it is new); answers then read the manifest instead of the rows.
Both parts are folders that readers of the table skip, and are appended to.
The trace index is written first, so a file that the manifest names is always
indexed; a refresh that is lost in between is made good by the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LOGS_SCHEMA, quoted
from .io import list_files

MANIFEST, TRACES = "_manifest", "_traces"
MANIFEST_SCHEMA = "path string, bytes long, dt string, hour int, level int, rows long, min_time timestamp, max_time timestamp, raw_bytes long, fingerprint long, labels map<string,map<string,long>>"
TRACES_SCHEMA = "trace_id string, path string, start_ns long, end_ns long, n_rows long"
#: A label with more values in a file has no counts there.
LABEL_VALUES = 100


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, root: str) -> DataFrame:
    """The stored manifest; empty before the first refresh."""
    return _read(spark, f"{root}/{MANIFEST}", MANIFEST_SCHEMA)


def traces(spark: SparkSession, root: str) -> DataFrame:
    """trace_id, path, start_ns, end_ns, n_rows."""
    return _read(spark, f"{root}/{TRACES}", TRACES_SCHEMA)


def undescribed(spark: SparkSession, root: str) -> DataFrame:
    """Files that the manifest does not know."""
    return list_files(spark, root).join(files(spark, root).select("path"), "path", "left_anti")


def read(spark: SparkSession, root: str, paths: list[str], schema: T.StructType = LOGS_SCHEMA) -> DataFrame:
    """Rows of some of a table's files, with dt, hour and path."""
    own = T.StructType([*schema.fields, T.StructField("dt", T.StringType()), T.StructField("hour", T.IntegerType())])
    rows = spark.read.schema(own).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], own)
    return rows.withColumn("path", F.col("_metadata.file_path") if paths else F.lit(""))


def _sized(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """What a description needs of each row: path, _ns, _bytes, whether each text has a value (_u0, ...), the labels (_l0, ...); trace_id and _start where there are traces."""
    texts = _texts(rows)
    size = reduce(Column.__add__, [F.coalesce(F.octet_length(quoted(c)), F.lit(0)).cast("long") for c in texts])
    used = [F.coalesce(F.col(quoted(c)) != "", F.lit(False)).alias(f"_u{k}") for k, c in enumerate(texts)]
    trace = [F.col("trace_id"), F.col("start_time_unix_nano" if "start_time_unix_nano" in rows.columns else "timestamp_unix_nano").alias("_start")] if "trace_id" in rows.columns else []
    return rows.select("path", F.col("timestamp_unix_nano").alias("_ns"), size.alias("_bytes"), *used, *[F.col(quoted(c)).alias(f"_l{k}") for k, c in enumerate(labels)], *trace)


def _texts(rows: DataFrame) -> list[str]:
    return sorted(f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ("path", "dt"))


def _described(sized: DataFrame, texts: list[str], labels: tuple[str, ...], cap: int) -> DataFrame:
    at = F.timestamp_micros(F.floor(F.col("_ns") / 1000).cast("long"))
    used = [F.when(F.max(f"_u{k}"), F.lit(c)) for k, c in enumerate(texts)]
    base = sized.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("min_time"), F.max(at).alias("max_time"), F.sum("_bytes").alias("raw_bytes"), F.xxhash64(F.concat_ws(",", *used)).alias("fingerprint"))
    pairs = F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"_l{k}").alias("value")) for k, name in enumerate(labels)])
    counts = sized.select("path", F.inline(pairs)).filter("value is not null").groupBy("path", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.withColumn("values", F.count(F.lit(1)).over(Window.partitionBy("path", "label"))).filter(F.col("values") <= cap)
    maps = few.groupBy("path", "label").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("m"))
    return base.join(maps.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("labels")), "path", "left")


def describe(rows: DataFrame, labels: tuple[str, ...], cap: int = LABEL_VALUES) -> DataFrame:
    """path, rows, min_time, max_time, raw_bytes (of all texts), fingerprint (of the columns with values), labels (counts of each label's values)."""
    return _described(_sized(rows, labels), _texts(rows), labels, cap)


def refresh(spark: SparkSession, root: str, labels: tuple[str, ...] = ("severity_text", "service.name"), schema: T.StructType = LOGS_SCHEMA, level: int = 0) -> int:
    """Describe files that are new; returns how many.  Their paths pass through the driver, as for any read of them.

    The files are read once: what the descriptions and the index need of a row
    is kept on the executors' disks.  Listing many files one by one costs more
    than reading them, so a table of which half is new is read from its root.
    """
    found = undescribed(spark, root).select("path", "bytes", "dt", "hour").collect()
    if not found:
        return 0
    new = spark.createDataFrame(found, "path string, bytes long, dt string, hour int")
    most = len(found) > 1 and len(found) >= files(spark, root).count()
    rows = read(spark, root, [root] if most else [r.path for r in found], schema)
    rows = rows.join(F.broadcast(new.select("path")), "path", "left_semi") if most else rows
    sized = _sized(rows, labels).persist(StorageLevel.DISK_ONLY)
    try:
        index = sized.filter("trace_id <> ''").groupBy("trace_id", "path").agg(F.min("_start").alias("start_ns"), F.max("_ns").alias("end_ns"), F.count(F.lit(1)).alias("n_rows"))
        index = index.repartitionByRange("trace_id").sortWithinPartitions("trace_id")
        index.write.mode("append").option("compression", "zstd").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(f"{root}/{TRACES}")
        known = new.join(_described(sized, _texts(rows), labels, LABEL_VALUES), "path").withColumn("level", F.lit(level))
        names = [f.name for f in T._parse_datatype_string(MANIFEST_SCHEMA).fields]
        # A shuffle, not coalesce, which would make the aggregations above run in as few tasks.
        known.select(*names).repartition(1 + len(found) // 100_000).write.mode("append").option("compression", "zstd").parquet(f"{root}/{MANIFEST}")
    finally:
        sized.unpersist()
    return len(found)


def trace_paths(spark: SparkSession, root: str, trace_id: str) -> list[str]:
    """Files that may hold a trace: those its index names, and those not yet described, as a miss there tells nothing."""
    own = traces(spark, root).filter(F.col("trace_id") == trace_id).select("path")
    return [r.path for r in own.unionByName(undescribed(spark, root).select("path")).distinct().collect()]


def trace_rows(spark: SparkSession, root: str, trace_id: str, schema: T.StructType = LOGS_SCHEMA) -> DataFrame:
    """The rows of a trace, from the files that may hold it only."""
    return read(spark, root, trace_paths(spark, root, trace_id), schema).filter(F.col("trace_id") == trace_id)


def files_with(known: DataFrame, label: str, value: str) -> DataFrame:
    """Files in which a label has a value; files without counts of that label may have it and are given too."""
    counts = F.col("labels")[label]
    return known.filter(counts.isNull() | F.map_contains_key(counts, F.lit(value)))
