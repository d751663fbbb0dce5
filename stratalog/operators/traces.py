"""Trace lookup, trace search, service graphs and span metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import bucket, duration_ns
from ..plans.parser import QueryError
from ..schema import INTEGRAL, quoted, resolve

#: Names of span kinds in tag filters.
KIND_NAMES = {"unspecified": 0, "internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}


def services(spans: DataFrame, limit: int = 1000) -> DataFrame:
    return spans.select(resolve(spans, "service.name").text.alias("service")).filter("service <> ''").distinct().orderBy("service").limit(limit)


def operations(spans: DataFrame, service: str) -> DataFrame:
    return spans.filter(F.col("`service.name`") == service).select(F.col("name").alias("operation")).filter("operation <> ''").distinct().orderBy("operation")


def trace_index(spans: DataFrame) -> DataFrame:
    """trace_id, start, end (ns of span times and durations), n_spans: a small table that answers where a trace lies."""
    start = F.unix_micros(F.col("_time").cast("timestamp")) * 1000
    return spans.groupBy("trace_id").agg(F.min(start).alias("start_ns"), F.max(start + F.greatest(F.coalesce("duration", F.lit(0)), F.lit(0))).alias("end_ns"), F.count(F.lit(1)).alias("n_spans"))


def trace(spans: DataFrame, trace_id) -> DataFrame:
    """One row per span of a trace in time order, with its reference, times in us and tags."""
    own = spans.filter(F.col("trace_id") == trace_id)
    start = F.unix_micros(F.col("_time").cast("timestamp"))
    return own.select(
        "trace_id", "span_id",
        F.when(F.coalesce(F.col("parent_span_id").cast("string"), F.lit("")) != "", F.lit("CHILD_OF")).alias("ref_type"),
        F.col("parent_span_id").alias("ref_span_id"),
        F.col("name").alias("operation"), F.col("`service.name`").alias("service"),
        start.alias("start_us"), F.floor(F.coalesce("duration", F.lit(0)) / 1000).cast("long").alias("duration_us"),
        (F.col("status_code") == 2).alias("error"), "kind",
    ).orderBy("start_us", "span_id")


def trace_document(spans: DataFrame, trace_id) -> DataFrame:
    """trace_id, spans (array), services: no row for an unknown trace."""
    t = trace(spans, trace_id)
    return t.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("start_us", "span_id", "operation", "service", "duration_us", "ref_type", "ref_span_id", "error", "kind"))).alias("spans"), F.array_sort(F.collect_set("service")).alias("services"))


def tag_test(spans: DataFrame, key: str, value: str) -> Column:
    if key == "error":
        failed = F.col("status_code") == 2
        return failed if value.lower() == "true" else ~failed
    if key == "span.kind":
        return F.col("kind") == KIND_NAMES.get(value.lower(), -1)
    for name in (key, f"span_attr:{key}", f"resource_attr:{key}"):
        f = resolve(spans, name)
        if f.raw or ":" in name:
            return f.text == value
    return resolve(spans, key).text == value


def matching(spans: DataFrame, service: str = "", operation: str = "", tags: dict[str, str] | None = None, min_duration: str = "", max_duration: str = "", start=None, end=None) -> DataFrame:
    """Spans that satisfy all conditions."""
    out = spans
    if service:
        out = out.filter(F.col("`service.name`") == service)
    if operation:
        out = out.filter(F.col("name") == operation)
    for k, v in (tags or {}).items():
        out = out.filter(tag_test(spans, k, v))
    if min_duration:
        out = out.filter(F.col("duration") >= duration_ns(min_duration))
    if max_duration:
        out = out.filter(F.col("duration") <= duration_ns(max_duration))
    if start is not None:
        out = out.filter(F.col("_time") >= start)
    return out.filter(F.col("_time") <= end) if end is not None else out


def search(spans: DataFrame, limit: int = 20, whole: bool = False, **conditions) -> DataFrame:
    """Spans of the `limit` newest traces with a matching span: the matching ones, or with `whole` all of theirs."""
    found = matching(spans, **conditions)
    ids = found.groupBy("trace_id").agg(F.max("_time").alias("_latest")).orderBy(F.desc("_latest"), "trace_id").limit(min(limit, 1000)).select("trace_id")
    return (spans if whole else found).join(ids, "trace_id", "left_semi")


def graph_halves(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, child, at: server and consumer spans by their parent's id; id, parent, at: client and producer spans by their own)."""
    kind = resolve(spans, "kind")
    of_kind = lambda *codes: kind.column.isin(*codes) if isinstance(kind.kind, INTEGRAL) else kind.text.isin(*map(str, codes))
    time = resolve(spans, "_time")
    at = F.timestamp_micros(F.floor(time.column / 1000).cast("long")) if isinstance(time.kind, T.LongType) else time.column.cast("timestamp")

    def half(key: str, name: str, *codes: int) -> DataFrame:
        return spans.filter(of_kind(*codes)).select(resolve(spans, key).text.alias("id"), F.col("`service.name`").alias(name), at.alias("at")).filter("id <> ''")

    return half("parent_span_id", "child", 2, 5), half("span_id", "parent", 3, 4)


def service_graph(spans: DataFrame) -> DataFrame:
    """parent, child, callCount: server and consumer spans under client and producer spans of another service."""
    child, parent = graph_halves(spans)
    return child.join(parent, "id").filter("parent <> child").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("callCount"))


def graph_of_edges(edges: DataFrame) -> DataFrame:
    """Edge rows of several periods, summed."""
    return edges.groupBy("parent", "child").agg(F.sum(F.col("callCount").cast("long")).alias("callCount"))


def dependency_map(spans: DataFrame, min_calls: int = 0) -> DataFrame:
    """The SQL variant: parent and child of one trace, any kind, own calls included; calls, errors and mean duration."""
    p, c = spans.alias("p"), spans.alias("c")
    joined = c.join(p, (F.col("c.trace_id") == F.col("p.trace_id")) & (F.col("c.parent_span_id") == F.col("p.span_id")))
    pairs = joined.select(F.col("p.service.name" if "service.name" not in spans.columns else "p.`service.name`").alias("parent"), F.col("c.`service.name`").alias("child"), F.col("c.duration").alias("d"), F.col("c.status_code").alias("s"))
    out = pairs.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("s") == 2, 1).otherwise(0)).alias("errors"), F.avg("d").alias("avg_duration"))
    return out.filter(F.col("calls") >= min_calls) if min_calls else out


_TRACEQL = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<and>&&)|(?P<or>\|\|)|(?P<name>[.\w:\-]+)\s*(?P<op>=~|!~|!=|>=|<=|=|>|<)\s*(?P<value>"(?:[^"\\]|\\.)*"|`[^`]*`|[^\s&|(){}]+))')


def traceql(spans: DataFrame, query: str) -> Column:
    """The condition of a span selector like { resource.service.name = "a" && duration > 10ms }."""
    m = re.fullmatch(r"\s*\{(.*)\}\s*", query, re.S)
    if not m:
        raise QueryError(f"expected a selector in braces: {query!r}")
    body, tokens, at = m[1].strip(), [], 0
    while at < len(body):
        t = _TRACEQL.match(body, at)
        if not t:
            raise QueryError(f"cannot read {body[at : at + 10]!r}")
        tokens.append(t)
        at = t.end()
        while at < len(body) and body[at].isspace():
            at += 1
    place = 0

    def either() -> Column:
        nonlocal place
        left = both()
        while place < len(tokens) and tokens[place]["or"]:
            place += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal place
        left = one()
        while place < len(tokens) and tokens[place]["and"]:
            place += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal place
        if place >= len(tokens):
            raise QueryError("the selector ends early")
        t = tokens[place]
        place += 1
        if t["open"]:
            inside = either()
            if place >= len(tokens) or not tokens[place]["close"]:
                raise QueryError("expected )")
            place += 1
            return inside
        if not t["name"]:
            raise QueryError("expected a condition")
        return compare(t["name"], t["op"], t["value"])

    def compare(name: str, op: str, raw: str) -> Column:
        value = raw[1:-1].replace('\\"', '"') if raw[0] in '"`' else raw
        intrinsic = {"status": "status_code", "statusMessage": "status_message", "rootName": "name"}
        if name == "status":
            value = {"error": "2", "ok": "1", "unset": "0"}.get(value, value)
        if name == "kind":
            value = str(KIND_NAMES.get(value, value))
        bare = intrinsic.get(name, re.sub(r"^(?:resource|span)?\.", "", name))
        if name.startswith("span.") and bare not in spans.columns:
            bare = "span_attr:" + bare
        f = resolve(spans, bare)
        if op in ("=~", "!~"):
            hit = F.rlike(f.text, F.lit(f"^(?:{value})$"))
            return hit if op == "=~" else ~hit
        if op in ("=", "!="):
            return (f.text == value) if op == "=" else (f.text != value)
        limit = float(duration_ns(value)) if re.fullmatch(r"[\d.]+[a-zµ]+.*", value) else float(value)
        n = f.number
        return F.coalesce({">": n > limit, ">=": n >= limit, "<": n < limit, "<=": n <= limit}[op], F.lit(False))

    if not tokens:
        return F.lit(True)
    out = either()
    if place != len(tokens):
        raise QueryError("the selector goes on after its end")
    return out


def traceql_search(spans: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """trace_id, start, matched, n_spans, root service and name of the newest traces with a matching span."""
    ids = spans.filter(traceql(spans, query)).groupBy("trace_id").agg(F.count(F.lit(1)).alias("matched"), F.max("_time").alias("_latest")).orderBy(F.desc("_latest"), "trace_id").limit(limit)
    whole = spans.join(ids.select("trace_id"), "trace_id", "left_semi")
    first = F.struct("_time", "span_id", F.col("`service.name`").alias("service"), "name")
    summary = whole.groupBy("trace_id").agg(F.min("_time").alias("start"), F.count(F.lit(1)).alias("n_spans"), F.min(first).alias("root"))
    return summary.join(ids, "trace_id").select("trace_id", "start", "matched", "n_spans", F.col("root.service").alias("root_service"), F.col("root.name").alias("root_name"))


def count_over_time(spans: DataFrame, query: str, step: str, by: tuple[str, ...] = ()) -> DataFrame:
    rows = spans.filter(traceql(spans, query)).select(bucket(F.col("_time"), step).alias("_time"), *[resolve(spans, b).text.alias(b) for b in by])
    return rows.groupBy("_time", *map(quoted, by)).agg(F.count(F.lit(1)).alias("value"))


def histogram_over_time(spans: DataFrame, query: str, step: str, field: str = "duration") -> DataFrame:
    """_time, bucket (power of two at or above the value), value."""
    f = resolve(spans, field)
    rows = spans.filter(traceql(spans, query)).select(bucket(F.col("_time"), step).alias("_time"), f.number.alias("v")).filter("v > 0")
    return rows.groupBy("_time", F.pow(F.lit(2.0), F.ceil(F.log2("v"))).alias("bucket")).agg(F.count(F.lit(1)).alias("value"))


def compare(spans: DataFrame, query: str, fields: tuple[str, ...], top: int = 10) -> DataFrame:
    """field, value, baseline, selection: for each field the `top` values (by both counts, ties by value) among spans a selector leaves out and those it picks."""
    picked = F.coalesce(traceql(spans, query), F.lit(False))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), resolve(spans, f).text.alias("value")) for f in fields])
    counted = spans.select(picked.alias("in"), F.inline(pairs)).filter("value <> ''").groupBy("field", "value").agg(F.count_if(~F.col("in")).alias("baseline"), F.count_if("in").alias("selection"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc(F.col("baseline") + F.col("selection")), "value"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank")


def logfmt_selector(tags: str) -> str:
    """A selector from logfmt tags: a=b c="d e" to { .a="b" && .c="d e" }."""
    found = re.findall(r'([^\s=]+)=("(?:[^"\\]|\\.)*"|\S*)', tags)
    return "{ " + " && ".join(f".{k}={v}" if v.startswith('"') else f'.{k}="{v}"' for k, v in found) + " }"


def tag_names(spans: DataFrame) -> DataFrame:
    from .enumerate import field_names

    return field_names(spans)


def tag_values(spans: DataFrame, tag: str) -> DataFrame:
    from .enumerate import field_values

    return field_values(spans, re.sub(r"^(?:resource|span)?\.", "", tag))
