"""Filters to columns and pipes to DataFrame operations.

Every test is two-valued: absent is the empty text, so a negated test keeps
rows that lack the field.  Tests on stored columns stay in forms that reach
the Parquet scan (`column = 'x'`, not `coalesce(column, '') = 'x'`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.times import bucket, duration_ns, end_of, is_duration, parse_time
from ..schema import INTEGRAL, Field, quoted, resolve, tie_names
from .ast import All, And, InQuery, Leaf, Not, Or, Query, Stream
from .parser import QueryError

#: Days as week ranges name them, numbered as dayofweek() does.
DAYS = {"sun": 1, "mon": 2, "tue": 3, "wed": 4, "thu": 5, "fri": 6, "sat": 7}


@dataclass
class Context:
    """What compiling needs besides the rows: the source of subqueries and the time that ages count from."""

    source: DataFrame
    now: datetime | None = None
    run: Callable[[Query], DataFrame] | None = None

    def clock(self) -> datetime:
        return self.now or datetime.now(UTC)


def instant(at: datetime) -> Column:
    return F.lit(at.astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")


def time_bounds(df: DataFrame, low: datetime | None, high: datetime | None, ends: tuple[bool, bool] = (True, True)) -> Column:
    """A predicate on `_time` and, where they are stored, on the partition columns `dt` and `hour` that it implies."""
    field = resolve(df, "_time")
    test = F.lit(True)

    def compare(at: datetime, is_low: bool, inclusive: bool) -> Column:
        c = field.column
        if isinstance(field.kind, T.LongType):  # nanoseconds
            micros = (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
            value = F.lit(micros * 1000 + (0 if is_low else 999) if inclusive else micros * 1000)
        else:
            value = instant(at).cast(field.kind)
        if is_low:
            return c >= value if inclusive else c > value
        return c <= value if inclusive else c < value

    for at, is_low, inclusive in ((low, True, ends[0]), (high, False, ends[1])):
        if at is not None:
            test = test & compare(at, is_low, inclusive)
            if "dt" in df.columns:
                day = F.lit(at.astimezone(UTC).strftime("%Y-%m-%d"))
                column = F.col("dt").cast("string")
                test = test & (column >= day if is_low else column <= day)
                if "hour" in df.columns:
                    hour = F.col("hour").cast("int")
                    edge = hour >= at.astimezone(UTC).hour if is_low else hour <= at.astimezone(UTC).hour
                    test = test & ((column != day) | edge)
    return test


def _exact(f: Field, value: str) -> Column:
    if value == "":
        return f.text == ""
    if isinstance(f.kind, T.StringType):
        return f.column == value
    if f.raw and isinstance(f.kind, INTEGRAL) and value.lstrip("-").isdigit() and str(int(value)) == value:
        return f.column == int(value)
    return f.text == value


def _size(text: str) -> float:
    """A number, with a duration's or a size's unit if it has one."""
    try:
        return float(text)
    except ValueError:
        pass
    if is_duration(text):
        return float(duration_ns(text))
    raise QueryError(f"no number: {text!r}")


def leaf(df: DataFrame, x: Leaf, ctx: Context) -> Column:
    """The column of one test."""
    if x.field == "_time" and x.op.startswith("time"):
        return _time_leaf(df, x, ctx)
    f = resolve(df, x.field)
    text, args = f.text, x.args
    if x.op == "exact":
        return _exact(f, args[0])
    if x.op == "exact_prefix":
        return F.startswith(f.column if isinstance(f.kind, T.StringType) else text, F.lit(args[0]))
    if x.op == "exists":
        return text != ""
    if x.op in ("phrase", "prefix"):
        return text == "" if args[0] == "" and x.op == "phrase" else tx.has_phrase(text, args[0], x.op == "prefix")
    if x.op in ("any_case_phrase", "any_case_prefix"):
        return tx.has_phrase(text, args[0], x.op == "any_case_prefix", any_case=True)
    if x.op == "regexp":
        return F.rlike(text, F.lit(args[0]))
    if x.op == "in":
        full = [a for a in args if a != ""]
        test = f.column.isin(full) if isinstance(f.kind, T.StringType) else text.isin(full)
        return (text == "") | test if "" in args else test if full else F.lit(False)
    if x.op == "range":
        low, high = map(_size, args)
        n = f.number
        return (n >= low if x.inclusive[0] else n > low) & (n <= high if x.inclusive[1] else n < high)
    if x.op in ("gt", "ge", "lt", "le"):
        try:
            limit = _size(args[0])
        except QueryError:
            n, limit = text, args[0]
        else:
            n = f.number
        return {"gt": n > limit, "ge": n >= limit, "lt": n < limit, "le": n <= limit}[x.op]
    if x.op == "string_range":
        return (text >= args[0]) & (text < args[1])
    if x.op == "len_range":
        return F.char_length(text).between(int(args[0]), 2**31 - 1 if args[1].lower() == "inf" else int(args[1]))
    if x.op == "ipv4_range":
        return tx.ipv4_number(text).between(*tx.ipv4_bounds(*args))
    if x.op == "ipv6_range":
        return tx.in_ipv6_range(text, *args)
    if x.op == "seq":
        return tx.has_sequence(text, list(args))
    if x.op in ("contains_all", "contains_any"):
        tests = [tx.has_phrase(text, a) for a in args]
        out = F.lit(x.op == "contains_all")
        for t in tests:
            out = out & t if x.op == "contains_all" else out | t
        return out
    if x.op == "equals_common_case":
        return text.isin([v for a in args for v in tx.common_cases(a)])
    if x.op == "contains_common_case":
        out = F.lit(False)
        for v in (v for a in args for v in tx.common_cases(a)):
            out = out | tx.has_phrase(text, v)
        return out
    if x.op == "json_array_contains_any":
        return F.arrays_overlap(F.from_json(text, "array<string>"), F.array(*map(F.lit, args)))
    if x.op in ("pattern_match", "pattern_match_full"):
        return tx.matches_pattern(text, args[0], x.op.endswith("full"))
    if x.op == "substring":
        return F.contains(text, F.lit(args[0]))
    if x.op == "eq_field":
        return text == resolve(df, args[0]).text
    if x.op in ("le_field", "lt_field"):
        other = resolve(df, args[0])
        numeric = f.number.isNotNull() & other.number.isNotNull()
        small = (f.number <= other.number, text <= other.text) if x.op == "le_field" else (f.number < other.number, text < other.text)
        return F.when(numeric, small[0]).otherwise(small[1])
    if x.op in ("day_range", "week_range"):
        at = resolve(df, x.field).column
        if isinstance(f.kind, T.LongType):
            at = F.timestamp_micros(F.floor(at / 1000).cast("long"))
        if x.op == "week_range":
            low, high = (DAYS[a[:3].lower()] for a in args)
            day = F.dayofweek(at)
            return (day >= low if x.inclusive[0] else day > low) & (day <= high if x.inclusive[1] else day < high)
        minute = F.hour(at) * 60 + F.minute(at)
        low, high = (int(a.split(":")[0]) * 60 + int((a.split(":") + ["0"])[1]) for a in args)
        return (minute >= low if x.inclusive[0] else minute > low) & (minute <= high if x.inclusive[1] else minute < high)
    raise QueryError(f"unknown filter {x.op}")


def _time_leaf(df: DataFrame, x: Leaf, ctx: Context) -> Column:
    now = ctx.clock()
    if x.op == "time_range":
        high = end_of(x.args[1], now) if x.inclusive[1] else parse_time(x.args[1], now)
        return time_bounds(df, parse_time(x.args[0], now), high, x.inclusive)
    if x.op == "time":
        shift = timedelta(microseconds=duration_ns(x.args[1]) / 1000) if x.args[1] else timedelta(0)
        if is_duration(x.args[0]):
            return time_bounds(df, parse_time(x.args[0], now) - shift, now - shift, (False, True))
        return time_bounds(df, parse_time(x.args[0], now) - shift, end_of(x.args[0], now) - shift)
    at = parse_time(x.args[0], now)
    return {"time_ge": time_bounds(df, at, None), "time_gt": time_bounds(df, at, None, (False, True)), "time_le": time_bounds(df, None, end_of(x.args[0], now)), "time_lt": time_bounds(df, None, at, (True, False))}[x.op]


def stream(df: DataFrame, x: Stream) -> Column:
    out = F.lit(False)
    for group in x.groups:
        test = F.lit(True)
        for tag, op, value in group:
            f = resolve(df, tag)
            if op in ("in", "not_in"):
                one = F.coalesce(f.text.isin(value.split("\x00")), F.lit(False))
                one = one if op == "in" else ~one
            elif op in ("=", "!="):
                one = _exact(f, value) if op == "=" else ~F.coalesce(_exact(f, value), F.lit(False))
            else:
                one = F.rlike(f.text, F.lit(f"^(?:{tx.checked_regexp(value)})$"))
                one = one if op == "=~" else ~one
            test = test & one
        out = out | test
    return out


def condition(df: DataFrame, x, ctx: Context) -> Column:
    """The column of a filter tree without subqueries."""
    if isinstance(x, All):
        return F.lit(True)
    if isinstance(x, Leaf):
        return leaf(df, x, ctx)
    if isinstance(x, Stream):
        return stream(df, x)
    if isinstance(x, Not):
        return ~F.coalesce(condition(df, x.part, ctx), F.lit(False))
    if isinstance(x, (And, Or)):
        out = condition(df, x.parts[0], ctx)
        for p in x.parts[1:]:
            out = out & condition(df, p, ctx) if isinstance(x, And) else out | condition(df, p, ctx)
        return out
    if isinstance(x, InQuery):
        raise QueryError("in(subquery) may stand by itself, under NOT, or joined to others with AND")
    raise QueryError(f"unknown filter {x!r}")


def apply_filter(df: DataFrame, x, ctx: Context) -> DataFrame:
    """Rows that pass; subqueries become semi and anti joins."""
    if isinstance(x, All):
        return df
    if isinstance(x, And):
        plain = tuple(p for p in x.parts if not _has_query(p))
        for p in x.parts:
            if _has_query(p):
                df = apply_filter(df, p, ctx)
        return df.filter(condition(df, And(plain), ctx)) if plain else df
    if isinstance(x, InQuery) or isinstance(x, Not) and isinstance(x.part, InQuery):
        q = x if isinstance(x, InQuery) else x.part
        found = ctx.run(q.query)
        if len(found.columns) != 1:
            raise QueryError("the query inside in() must give one field")
        values = found.select(resolve(found, found.columns[0]).text.alias("_in")).distinct()
        return df.join(values, resolve(df, q.field).text == F.col("_in"), "left_semi" if x is q else "left_anti")
    return df.filter(condition(df, x, ctx))


def _has_query(x) -> bool:
    if isinstance(x, InQuery):
        return True
    if isinstance(x, Not):
        return _has_query(x.part)
    return isinstance(x, (And, Or)) and any(map(_has_query, x.parts))


def ordering(df: DataFrame, keys: tuple[tuple[str, bool], ...], desc_ties: bool = False) -> list[Column]:
    """Sort columns: typed columns by value, texts by number first (numbers before other texts), then by text; ties by all other columns."""
    out = []
    for name, desc in keys:
        f = resolve(df, name)
        columns = [f.number, f.text] if isinstance(f.kind, T.StringType) else [f.column]
        out += [c.desc_nulls_last() if desc else c.asc_nulls_last() for c in columns]
    named = {k for k, _ in keys}
    ties = [F.col(quoted(t)) for t in tie_names(df) if t not in named]
    return out + [t.desc() if desc_ties else t.asc() for t in ties]


def group_columns(df: DataFrame, by: tuple[tuple[str, str], ...]) -> list[Column]:
    out = []
    for name, step in by:
        f = resolve(df, name)
        if not step:
            out.append((f.text if isinstance(f.kind, T.StringType) else f.column).alias(name))
        elif name == "_time":
            at = F.timestamp_micros(F.floor(f.column / 1000).cast("long")) if isinstance(f.kind, T.LongType) else f.column
            out.append(bucket(at, step).alias(name))
        else:
            width = _size(step)
            out.append((F.floor(f.number / width) * width).alias(name))
    return out


def empty_like(df: DataFrame, name: str) -> Column:
    """A field as a result column: stored columns as they are, others as text."""
    f = resolve(df, name)
    return f.column.alias(name)
