"""The data model: logs and spans, field names and how a field name finds its column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text_map = T.MapType(T.StringType(), T.StringType())


def _fields(kind: T.DataType, names: Iterable[str]) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


#: Stored columns of log rows and span rows.
RESOURCE_COLUMNS = ["service.name", "k8s.namespace.name", "k8s.pod.name", "k8s.deployment.name", "k8s.node.name", "deployment.environment", "cloud.region", "host.name"]
LOGS_SCHEMA = T.StructType(
    _fields(T.LongType(), ["account_id", "project_id", "timestamp_unix_nano"])
    + _fields(T.StringType(), ["body", "severity_text"])
    + _fields(T.IntegerType(), ["severity_number"])
    + _fields(T.StringType(), [*RESOURCE_COLUMNS, "trace_id", "span_id", "_stream", "_stream_id", "scope.name"])
    + _fields(_text_map, ["resource.attributes", "log.attributes", "scope.attributes"])
)
SPANS_SCHEMA = T.StructType(
    _fields(T.LongType(), ["account_id", "project_id", "timestamp_unix_nano", "start_time_unix_nano", "duration_ns"])
    + _fields(T.StringType(), ["trace_id", "span_id", "parent_span_id", "span.name"])
    + _fields(T.IntegerType(), ["span.kind", "status.code"])
    + _fields(T.StringType(), ["status.message", *RESOURCE_COLUMNS, "http.method", "http.status_code", "http.url", "db.system", "db.statement", "scope.name", "parent", "child", "callCount"])
    + _fields(_text_map, ["resource.attributes", "span.attributes", "scope.attributes"])
)
#: Query names of stored columns.
LOG_NAMES = {"_time": "timestamp_unix_nano", "_msg": "body", "level": "severity_text"}
SPAN_NAMES = {"_time": "timestamp_unix_nano", "name": "span.name", "kind": "span.kind", "status_code": "status.code", "status_message": "status.message", "duration": "duration_ns"}
#: Prefixes that name one attribute map.
MAP_PREFIXES = {"resource_attr:": "resource.attributes", "log_attr:": "log.attributes", "span_attr:": "span.attributes", "scope_attr:": "scope.attributes"}
#: Maps in order of precedence.
MAPS = ("resource.attributes", "log.attributes", "span.attributes", "scope.attributes")
#: OpenTelemetry severity numbers, four to a name, and enumerations of spans.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
SPAN_KINDS = {0: "SPAN_KIND_UNSPECIFIED", 1: "SPAN_KIND_INTERNAL", 2: "SPAN_KIND_SERVER", 3: "SPAN_KIND_CLIENT", 4: "SPAN_KIND_PRODUCER", 5: "SPAN_KIND_CONSUMER"}
STATUS_CODES = {0: "STATUS_CODE_UNSET", 1: "STATUS_CODE_OK", 2: "STATUS_CODE_ERROR"}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Field:
    """A resolved field: its column and type; `raw` if it is a stored column that predicates may be pushed to."""

    column: Column
    kind: T.DataType
    raw: bool

    @property
    def text(self) -> Column:
        """The value as text; absent is the empty text."""
        column = self.column
        if isinstance(self.kind, T.StringType):
            return F.coalesce(column, F.lit(""))
        return F.coalesce(column.cast("string"), F.lit(""))

    @property
    def number(self) -> Column:
        """The value as a double, null where it is none."""
        if isinstance(self.kind, NUMERIC):
            return self.column.cast("double")
        return self.column.try_cast("double")


def resolve(df: DataFrame, name: str) -> Field:
    """A field by query name, stored name, prefixed map key or bare map key; unknown names are empty.

    A promoted column wins over a map key of the same name, and the first map
    that has the key wins over later ones.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def key(m: str, k: str) -> Column:
        return F.nullif(F.col(quoted(m))[k], F.lit(""))

    for prefix, m in MAP_PREFIXES.items():
        if name.startswith(prefix):
            bare = name.removeprefix(prefix)
            promoted = [F.nullif(F.col(quoted(bare)), F.lit(""))] if isinstance(kinds.get(bare), T.StringType) else []
            parts = promoted + ([key(m, bare)] if m in kinds else [])
            return Field(F.coalesce(*parts, F.lit("")) if parts else F.lit(""), T.StringType(), False)
    maps = [m for m in MAPS if isinstance(kinds.get(m), T.MapType)]
    for stored in (name, LOG_NAMES.get(name), SPAN_NAMES.get(name)):
        if stored in kinds:
            return Field(F.col(quoted(stored)), kinds[stored], True)
    if maps:
        return Field(F.coalesce(*[key(m, name) for m in maps], F.lit("")), T.StringType(), False)
    return Field(F.lit(""), T.StringType(), False)


def tie_names(df: DataFrame) -> list[str]:
    """Columns that break ties, so that limits do not depend on the order of arrival: the time, the stream's id, then all other sortable ones."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    first = [c for c in ("_time", LOG_NAMES["_time"], "_stream_id") if c in plain]
    return first + [c for c in plain if c not in first]


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def severity(text: Column, number: Column, stream_level: Column | None = None) -> Column:
    """Level of a log row: its text, else from its number 1 to 24, else the stream's tag, else empty."""
    named = F.element_at(F.array(*map(F.lit, SEVERITIES)), ((number - 1) / 4).cast("int") + 1)
    return F.coalesce(F.nullif(text, F.lit("")), F.when(number.between(1, 24), named), F.nullif(stream_level, F.lit("")) if stream_level is not None else F.lit(None).cast("string"), F.lit(""))


def flatten(df: DataFrame) -> DataFrame:
    """Typed columns as they are plus `attributes`: all map entries that no promoted column shadows, first map first."""
    own = sorted(f.name for f in df.schema.fields)
    maps = [m for m in MAPS if m in own]
    none = F.expr("cast(map() as map<string, string>)")

    def fresh(entries: Column, seen: Column) -> Column:
        return F.map_filter(entries, lambda k, v: (F.coalesce(v, F.lit("")) != "") & ~F.map_contains_key(seen, k) & ~k.isin(own))

    merged = none
    for m in maps:  # an entry is added unless an earlier map has its key
        merged = F.map_concat(merged, fresh(F.coalesce(F.col(quoted(m)), none), merged))
    return df.select(*[quoted(c) for c in df.columns if c not in maps], merged.alias("attributes"))


def enum_name(column: Column, names: dict[int, str]) -> Column:
    """The name of a code, the empty text for others."""
    out = F.lit("")
    for code, name in sorted(names.items(), reverse=True):
        out = F.when(column == code, F.lit(name)).otherwise(out)
    return out


def stream_of(tags: dict[str, Column]) -> Column:
    """The canonical stream text {a="x",b="y"} of tag columns, in tag order, empty tags left out."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'{k}="'), c, F.lit('"'))) for k, c in sorted(tags.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def stream_id(stream: Column, account: Column, project: Column) -> Column:
    """A deterministic 48-digit id: 8 + 8 hex digits of the tenant and 32 of the stream's hash (an own layout)."""
    return F.concat(F.lpad(F.lower(F.hex(account)), 8, "0"), F.lpad(F.lower(F.hex(project)), 8, "0"), F.substring(F.sha2(stream, 256), 1, 32))


def time_text(ns: Column) -> Column:
    """RFC 3339 in UTC with nanoseconds, trailing zeros trimmed, from a long of nanoseconds."""
    second = F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")
    rest = F.regexp_replace(F.lpad((ns - second * 1_000_000_000).cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.lit("Z"))
