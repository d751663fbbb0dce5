"""Reading, mapping and writing rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LOGS_SCHEMA, SPANS_SCHEMA, quoted, severity, stream_id, stream_of

#: Keys that the ingest of log lines reads the time, message and level from.
LINE_TIME, LINE_MESSAGE, LINE_LEVEL = "_time", "_msg", "level"
#: For tables of many files.  Where Hadoop's native library is missing, its local file system starts a process for the
#: mode of each new file and one for that of its checksum file; the raw one starts none.  Parquet's pages have
#: checksums of their own.  Paths of other file systems are not concerned.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Rows that one task of a write sorts, by Spark's estimate of their size, and the number of tasks beyond which there was no estimate.
TASK_BYTES, MOST_TASKS = 16 << 20, 100_000


def read_table(spark: SparkSession, root: str, schema: T.StructType = LOGS_SCHEMA) -> DataFrame:
    """A partitioned table; columns that older files lack are null, missing files raise."""
    own = T.StructType([*schema.fields, T.StructField("dt", T.StringType()), T.StructField("hour", T.IntegerType())])
    return spark.read.schema(own).parquet(root)


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType = LOGS_SCHEMA) -> DataFrame:
    """Just these files."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, modified of each stored file, with its partition."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    part = lambda name, to: F.nullif(F.regexp_extract("path", rf"{name}=([^/]+)", 1), F.lit("")).cast(to)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), part("dt", "string").alias("dt"), part("hour", "int").alias("hour"))


def dealt(df: DataFrame, *by: str | Column) -> DataFrame:
    """`df` dealt by columns: to more tasks than the session's number if its size asks for it, so that what a task sorts stays bounded."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES
    return df.repartition(n, *by) if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n <= MOST_TASKS else df.repartition(*by)


def write_table(df: DataFrame, root: str, mode: str = "append", blooms: tuple[str, ...] = ("trace_id",), files_per_hour: int = 1) -> None:
    """Write rows under dt=/hour= of their UTC time, sorted by time, compressed, with Bloom filters.

    Rows are dealt by partition (and a salt if an hour has several files), so
    no task writes to every hour.
    """
    at = F.timestamp_micros(F.floor(F.col("timestamp_unix_nano") / 1000).cast("long"))
    rows = df.withColumn("dt", F.date_format(at, "yyyy-MM-dd")).withColumn("hour", F.hour(at))
    salt = F.pmod(F.xxhash64("timestamp_unix_nano"), F.lit(files_per_hour)).cast("int")
    rows = dealt(rows, "dt", "hour", salt).sortWithinPartitions("dt", "hour", "timestamp_unix_nano")
    out = rows.write.mode(mode).partitionBy("dt", "hour").option("compression", "zstd").options(**PLAIN_FILES)
    for name in blooms:
        out = out.option(f"parquet.bloom.filter.enabled#{name}", "true")
    out.parquet(root)


def overwrite_partitions(df: DataFrame, root: str, *parts: str) -> None:
    """Write partitions in the place of those of the same values; others stay."""
    df.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).option("compression", "zstd").parquet(root)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON lines as text."""
    return spark.read.text(path)


def bulk_lines(lines: DataFrame) -> DataFrame:
    """The documents of bulk requests: lines that are no action lines."""
    action = F.rlike("value", F.lit(r'^\s*\{\s*"(?:create|index|update|delete)"\s*:\s*\{[^{}]*\}\s*\}\s*$'))
    return lines.filter(~action & (F.trim("value") != ""))


def log_rows(lines: DataFrame, stream_fields: tuple[str, ...] = ("service.name",), account: int = 0, project: int = 0, value: str = "value") -> DataFrame:
    """Stored log rows from JSON lines: known keys to their columns, the rest to `log.attributes`."""
    return mapped_rows(_parsed(lines, value), stream_fields, account, project)


def _parsed(lines: DataFrame, value: str) -> DataFrame:
    """m: the map of each JSON line that is an object.  As a generator's output it is parsed once, not again for the filter."""
    return lines.select(F.explode(F.array(F.from_json(F.col(value), "map<string,string>"))).alias("m")).filter(F.col("m").isNotNull())


def mapped_rows(parsed: DataFrame, stream_fields: tuple[str, ...] = ("service.name",), account: int = 0, project: int = 0) -> DataFrame:
    """Stored log rows from maps `m` of keys and texts."""
    m = F.col("m")
    known = {f.name for f in LOGS_SCHEMA.fields if isinstance(f.dataType, T.StringType)} - {"body", "severity_text", "_stream", "_stream_id"}
    special = {LINE_TIME, LINE_MESSAGE, LINE_LEVEL, "severity_number", "severity_text", "body"}
    text = lambda k: F.coalesce(m[k], F.lit(""))
    stream = stream_of({k: text(k) for k in stream_fields})
    number = m["severity_number"].try_cast("int")
    values: dict[str, Column] = {
        "account_id": F.lit(account).cast("long"),
        "project_id": F.lit(project).cast("long"),
        "timestamp_unix_nano": nanos(m[LINE_TIME]),
        "body": F.coalesce(m[LINE_MESSAGE], m["body"], F.lit("")),
        "severity_text": severity(F.coalesce(m[LINE_LEVEL], m["severity_text"]), number),
        "severity_number": F.coalesce(number, F.lit(0)),
        "_stream": stream,
        "_stream_id": stream_id(stream, F.lit(account), F.lit(project)),
        "log.attributes": F.map_filter(m, lambda k, v: ~k.isin(sorted(known | special)) & (F.coalesce(v, F.lit("")) != "")),
        "resource.attributes": F.expr("cast(map() as map<string,string>)"),
        "scope.attributes": F.expr("cast(map() as map<string,string>)"),
    } | {k: text(k) for k in known}
    return parsed.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in LOGS_SCHEMA.fields])


def span_rows(lines: DataFrame, account: int = 0, project: int = 0, value: str = "value") -> DataFrame:
    """Stored span rows from flat JSON lines: `resource_attr:` and `span_attr:` keys to columns or maps."""
    parsed = _parsed(lines, value)
    m = F.col("m")
    names = {f.name: f.dataType for f in SPANS_SCHEMA.fields}
    start = F.coalesce(m["start_time_unix_nano"].try_cast("long"), F.lit(0).cast("long"))
    duration = F.coalesce(m["duration"].try_cast("long"), F.lit(0).cast("long"))

    def attributes(prefix: str) -> Column:
        own = F.map_filter(m, lambda k, v: F.startswith(k, F.lit(prefix)) & (F.coalesce(v, F.lit("")) != ""))
        bare = F.transform_keys(own, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
        return F.map_filter(bare, lambda k, v: ~k.isin(sorted(n for n, t in names.items() if isinstance(t, T.StringType))))

    direct = {"span.name": "name", "span.kind": "kind", "status.code": "status_code", "status.message": "status_message"}
    values: dict[str, Column] = {
        "account_id": F.lit(account), "project_id": F.lit(project), "start_time_unix_nano": start, "duration_ns": duration, "timestamp_unix_nano": start + duration,
        "resource.attributes": attributes("resource_attr:"), "span.attributes": attributes("span_attr:"), "scope.attributes": attributes("scope_attr:"),
    }
    for n, kind in names.items():
        if n not in values:
            got = F.coalesce(*[m[k] for k in (direct.get(n, n), f"resource_attr:{n}", f"span_attr:{n}")])
            values[n] = F.coalesce(got, F.lit("")) if isinstance(kind, T.StringType) else F.coalesce(got.try_cast(kind), F.lit(0))
    return parsed.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SPANS_SCHEMA.fields])


def nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of RFC 3339 text or an epoch number in s, ms, us or ns; 0 if neither."""
    number = text.try_cast("decimal(20,0)")
    scaled = F.when(F.abs(number) < 10**11, number * 10**9).when(F.abs(number) < 10**14, number * 10**6).when(F.abs(number) < 10**17, number * 10**3).otherwise(number).cast("long")
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0").try_cast("long")
    whole = F.unix_seconds(F.regexp_replace(text, r"\.\d+", "").try_cast("timestamp"))
    return F.coalesce(scaled, whole * 1_000_000_000 + F.coalesce(fraction, F.lit(0).cast("long")), F.lit(0).cast("long"))


#: The parts of OTLP's JSON that rows are made of, and Loki's push request.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
OTLP_LOGS = f"""struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<scope:struct<name:string,attributes:{_ATTRIBUTES}>,
 logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_VALUE},attributes:{_ATTRIBUTES},traceId:string,spanId:string>>>>>>>"""
OTLP_SPANS = f"""struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string,attributes:{_ATTRIBUTES}>,
 spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:int,message:string>>>>>>>>"""
LOKI_PUSH = "struct<streams:array<struct<stream:map<string,string>,values:array<array<string>>>>>"


def _plain(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"], value["boolValue"], F.lit(""))


def _entries(attributes: Column, prefix: str = "") -> Column:
    """The map of a list of attributes; of repeated keys the last counts."""
    pairs = F.coalesce(attributes, F.expr(f"cast(array() as {_ATTRIBUTES})"))
    last = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.struct(F.concat(F.lit(prefix), k).alias("k"), _plain(F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]).alias("v")))
    return F.map_from_entries(last)


def _merged(*maps: Column) -> Column:
    """Later maps win."""

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)

    return reduce(over, maps)


def otlp_log_lines(requests: DataFrame, value: str = "value") -> DataFrame:
    """OTLP log requests (JSON) as JSON lines for `log_rows`."""
    return otlp_log_maps(requests, value).select(F.to_json("m").alias("value"))


def otlp_log_maps(requests: DataFrame, value: str = "value") -> DataFrame:
    """OTLP log requests (JSON) as maps for `mapped_rows`: attributes of record, scope and resource by their keys, the record's first."""
    r = requests.select(F.explode(F.from_json(F.col(value), OTLP_LOGS)["resourceLogs"]).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s"))
    x = s.select("ra", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("x"))
    time = F.coalesce(F.nullif(F.col("x.timeUnixNano"), F.lit("0")), F.col("x.observedTimeUnixNano"), F.lit("0"))
    own = {LINE_TIME: time, LINE_MESSAGE: _plain(F.col("x.body")), LINE_LEVEL: F.coalesce("x.severityText", F.lit("")), "severity_number": F.coalesce(F.col("x.severityNumber"), F.lit(0)).cast("string"), "trace_id": F.coalesce("x.traceId", F.lit("")), "span_id": F.coalesce("x.spanId", F.lit("")), "scope.name": F.coalesce("scope.name", F.lit(""))}
    named = F.create_map(*[c for k, v in own.items() for c in (F.lit(k), v)])
    return x.select(_merged(_entries(F.col("ra")), _entries(F.col("scope.attributes")), _entries(F.col("x.attributes")), named).alias("m"))


def otlp_span_lines(requests: DataFrame, value: str = "value") -> DataFrame:
    """OTLP trace requests (JSON) as flat JSON lines for `span_rows`."""
    r = requests.select(F.explode(F.from_json(F.col(value), OTLP_SPANS)["resourceSpans"]).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s"))
    x = s.select("ra", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("x"))
    start, end = F.col("x.startTimeUnixNano").try_cast("long"), F.col("x.endTimeUnixNano").try_cast("long")
    own = {"trace_id": "x.traceId", "span_id": "x.spanId", "parent_span_id": "x.parentSpanId", "name": "x.name", "kind": "x.kind", "status_code": "x.status.code", "status_message": "x.status.message", "start_time_unix_nano": "x.startTimeUnixNano", "scope.name": "scope.name"}
    pairs = {k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in own.items()} | {"duration": F.coalesce((end - start).cast("string"), F.lit("0"))}
    named = F.create_map(*[c for k, v in pairs.items() for c in (F.lit(k), v)])
    maps = _entries(F.col("ra"), "resource_attr:"), _entries(F.col("scope.attributes"), "scope_attr:"), _entries(F.col("x.attributes"), "span_attr:")
    return x.select(F.to_json(F.map_filter(_merged(*maps, named), lambda k, v: v != "")).alias("value"))


def loki_lines(requests: DataFrame, value: str = "value") -> DataFrame:
    """Loki push requests (JSON) as JSON lines for `log_rows`: labels by their names, a value's time and text."""
    s = requests.select(F.explode(F.from_json(F.col(value), LOKI_PUSH)["streams"]).alias("s"))
    x = s.select(F.coalesce("s.stream", F.expr("cast(map() as map<string,string>)")).alias("labels"), F.explode("s.values").alias("v"))
    meta = F.coalesce(F.from_json(F.get("v", F.lit(2)), "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    named = F.create_map(F.lit(LINE_TIME), F.coalesce(F.get("v", F.lit(0)), F.lit("0")), F.lit(LINE_MESSAGE), F.coalesce(F.get("v", F.lit(1)), F.lit("")))
    return x.select(F.to_json(_merged(F.col("labels"), meta, named)).alias("value"))


def trace_shaped(stream: Column) -> Column:
    """Whether a log row's stream is that of a span or edge row."""
    s = F.coalesce(stream, F.lit(""))
    return F.contains(s, F.lit("resource_attr:")) | F.startswith(s, F.lit('{name="')) | F.contains(s, F.lit("trace_service_graph_stream="))


def drop_trace_shaped(df: DataFrame) -> DataFrame:
    return df.filter(~trace_shaped(F.col("_stream")))


def promote(df: DataFrame, attributes: str, names: list[str]) -> DataFrame:
    """Schema healing: an empty promoted column takes the map's entry, which then leaves the map."""
    m = F.coalesce(F.col(quoted(attributes)), F.expr("cast(map() as map<string,string>)"))
    out = []
    for c in df.columns:
        if c in names:
            out.append(F.coalesce(F.nullif(F.col(quoted(c)), F.lit("")), m[c], F.lit("")).alias(c))
        elif c == attributes:
            out.append(F.map_filter(m, lambda k, v: ~k.isin(names)).alias(c))
        else:
            out.append(F.col(quoted(c)))
    return df.select(*out)


def with_recent(flushed: DataFrame, recent: DataFrame, time: str = "timestamp_unix_nano") -> DataFrame:
    """Stored rows and buffered rows after the newest stored one, without either twice."""
    mark = flushed.agg(F.max(time)).scalar()
    later = recent.filter(mark.isNull() | (F.col(time) > mark))
    return flushed.unionByName(later, allowMissingColumns=True)


def otel_view(df: DataFrame) -> DataFrame:
    """Log rows under the names of the OpenTelemetry data model."""
    c = lambda n: F.col(quoted(n))
    return df.select(
        F.timestamp_micros(F.floor(c("timestamp_unix_nano") / 1000).cast("long")).alias("Timestamp"),
        c("trace_id").alias("TraceId"), c("span_id").alias("SpanId"), c("severity_text").alias("SeverityText"), c("severity_number").alias("SeverityNumber"),
        c("service.name").alias("ServiceName"), c("body").alias("Body"),
        F.map_concat(F.map_filter(F.coalesce(c("resource.attributes"), F.expr("cast(map() as map<string,string>)")), lambda k, v: k != "service.name"), F.create_map(F.lit("service.name"), c("service.name"))).alias("ResourceAttributes"),
        c("log.attributes").alias("LogAttributes"),
    )
