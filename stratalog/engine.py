"""Queries over a table of logs or spans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.times import bucket, parse_time
from .operators import enumerate as en
from .operators.pipes import PIPES
from .plans.ast import And, Pipe, Query
from .plans.compiler import Context, apply_filter, ordering, time_bounds
from .plans.parser import QueryError, parse
from .schema import resolve


class Engine:
    """Runs pipe queries on one table; results are lazy DataFrames."""

    def __init__(self, table: DataFrame, now: datetime | None = None, tenant: tuple[int, int] | None = None, hidden: tuple[str, ...] = (), max_rows: int | None = None):
        """tenant: only its rows are seen; hidden: fields (or prefixes ending in *) that are not; max_rows: a query with more result rows fails."""
        if tenant is not None:
            table = table.filter((F.col("account_id") == tenant[0]) & (F.col("project_id") == tenant[1]))
        if hidden:
            gone = [c for c in table.columns if any(c == h or h.endswith("*") and c.startswith(h[:-1]) for h in hidden)]
            table = table.drop(*[F.col(f"`{c}`") for c in gone])
        self.table, self.now, self.max_rows = table, now, max_rows

    def plan(self, query: Query, start=None, end=None, extra_filters: str = "") -> DataFrame:
        ctx = Context(self.table, self.now, self.plan)
        df = self.table
        if start is not None or end is not None:
            low = parse_time(start, self.now) if start is not None else None
            high = parse_time(end, self.now) if end is not None else None
            df = df.filter(time_bounds(df, low, high))
        test = query.filter
        if extra_filters:
            test = And((parse(extra_filters).filter, test))
        df = apply_filter(df, test, ctx)
        for p in query.pipes:
            df = PIPES[p.name](df, p, ctx)
        return df

    def query(self, text: str, start=None, end=None, limit: int | None = None, offset: int = 0, extra_filters: str = "") -> DataFrame:
        """Rows of a query; with `limit` the newest ones."""
        df = self.plan(parse(text), start, end, extra_filters)
        if limit is not None or offset:
            if resolve(df, "_time").raw:
                df = df.orderBy(*ordering(df, (("_time", True),), True))
            df = df.offset(offset) if offset else df
            df = df.limit(limit) if limit is not None else df
        return df if self.max_rows is None else bounded(df, self.max_rows)

    def stats_query(self, text: str, time=None, **more) -> DataFrame:
        """An instant vector; the query must end in statistics."""
        q = parse(text)
        self._stats_pipe(q)
        return self.plan(q, end=time, **more)

    def _stats_pipe(self, q: Query) -> int:
        at = next((k for k in range(len(q.pipes) - 1, -1, -1) if q.pipes[k].name == "stats"), None)
        if at is None:
            raise QueryError("the query has no stats pipe")
        return at

    def stats_query_range(self, text: str, step: str = "1d", start=None, end=None, **more) -> DataFrame:
        """A matrix: the statistics of each step's bucket."""
        q = parse(text)
        at = self._stats_pipe(q)
        p = q.pipes[at]
        pipes = [*q.pipes[:at], Pipe("stats", p.args | {"by": (("_time", step), *p["by"])}), *q.pipes[at + 1 :]]
        return self.plan(Query(q.filter, tuple(pipes)), start, end, **more)

    def hits(self, text: str = "*", step: str = "1d", fields: tuple[str, ...] = (), start=None, end=None, fields_limit: int | None = None, **more) -> DataFrame:
        """_time, fields, hits: rows in each step's bucket."""
        df = self.plan(parse(text), start, end, **more)
        at = resolve(df, "_time")
        time = F.timestamp_micros(F.floor(at.column / 1000).cast("long")) if isinstance(at.kind, T.LongType) else at.column
        rows = df.select(bucket(time, step).alias("_time"), *[resolve(df, f).text.alias(f) for f in fields])
        if fields_limit is not None and len(fields) == 1:  # rarer values are counted under the empty one
            top = rows.groupBy(f"`{fields[0]}`").count().orderBy(F.desc("count"), f"`{fields[0]}`").limit(fields_limit).select(F.col(f"`{fields[0]}`").alias("_top"))
            rows = rows.join(top, F.col(f"`{fields[0]}`") == F.col("_top"), "left").select("_time", F.coalesce("_top", F.lit("")).alias(fields[0]))
        return rows.groupBy("_time", *[f"`{f}`" for f in fields]).agg(F.count(F.lit(1)).alias("hits"))

    def field_names(self, text: str = "*", **more) -> DataFrame:
        return en.field_names(self.plan(parse(text), **more))

    def field_values(self, field: str, text: str = "*", limit: int | None = None, contains: str = "", **more) -> DataFrame:
        return en.field_values(self.plan(parse(text), **more), field, limit, contains)

    def facets(self, text: str = "*", limit: int = 10, **more) -> DataFrame:
        return en.facets(self.plan(parse(text), **more), limit)

    def streams(self, text: str = "*", limit: int | None = None, **more) -> DataFrame:
        return en.streams(self.plan(parse(text), **more), limit)


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """The rows of a result; reading them raises if there are more than `max_rows`, which a count of its own tells, so none passes through one task."""
    count = df.agg(F.count(F.lit(1))).scalar()
    failed = F.raise_error(F.concat(count.cast("string"), F.lit(f" result rows, {max_rows} are allowed"))).cast("boolean")
    return df.filter(F.when(count > max_rows, failed).otherwise(F.lit(True)))


def rows_json(df: DataFrame) -> DataFrame:
    """One JSON line per row; null fields and empty texts are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = [(F.nullif(F.col(f"`{c}`"), F.lit("")) if isinstance(kinds[c], T.StringType) else F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*values)).alias("line"))


def vector(df: DataFrame, value: str, at: str = "") -> DataFrame:
    """metric (map of labels), value (text): an instant vector."""
    labels = [c for c in df.columns if c not in (value, at or "_time")]
    metric = F.create_map(*[x for c in labels for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]) if labels else F.expr("cast(map() as map<string,string>)")
    keep = [F.col(at).alias("timestamp")] if at else []
    return df.select(metric.alias("metric"), *keep, F.col(f"`{value}`").cast("string").alias("value"))


def matrix(df: DataFrame, value: str) -> DataFrame:
    """metric, values: for each label set its (time, value) pairs in order."""
    v = vector(df, value, "_time").select(F.to_json("metric").alias("metric"), F.struct("timestamp", "value").alias("p"))
    return v.groupBy("metric").agg(F.array_sort(F.collect_list("p")).alias("values"))
