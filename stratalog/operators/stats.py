"""The statistics of the stats pipe: one aggregation for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import Aggregate
from ..plans.compiler import Context, condition, group_columns
from ..plans.parser import QueryError
from ..schema import quoted, resolve

#: Buckets of a histogram per power of ten.
HISTOGRAM_STEPS = 18
#: Relative error of count_uniq_hash.
UNIQ_ERROR = 0.01


def histogram_bucket(value: Column) -> Column:
    """Lower bound of a value's bucket: logarithmic, `HISTOGRAM_STEPS` to a power of ten; 0 for values up to 1e-9."""
    step = F.floor(F.log10(value) * HISTOGRAM_STEPS)
    return F.when(value > 1e-9, F.pow(F.lit(10.0), step / HISTOGRAM_STEPS)).otherwise(F.lit(0.0))


def uniq_key(df: DataFrame, a: Aggregate, ctx: Context) -> Column:
    """What count_uniq and count_uniq_hash count: null where all fields are empty or the condition fails."""
    test = F.coalesce(condition(df, a.condition, ctx), F.lit(False)) if a.condition is not None else None
    fs = [resolve(df, n) for n in a.args if n != "*"]
    f = fs[0]
    if len(fs) == 1:
        typed = F.nullif(f.column, F.lit("")) if isinstance(f.kind, T.StringType) else f.column
        key = typed if a.func == "count_uniq" else F.nullif(f.text, F.lit(""))
    else:
        any_set = F.lit(False)
        for x in fs:
            any_set = any_set | (x.text != "")
        key = F.when(any_set, F.struct(*[x.text.alias(f"c{k}") for k, x in enumerate(fs)]))
        key = key if a.func == "count_uniq" else F.xxhash64(key)
    return key if test is None else F.when(test, key)


def column(df: DataFrame, a: Aggregate, ctx: Context) -> Column:
    """The aggregate column of one statistic."""
    test = F.coalesce(condition(df, a.condition, ctx), F.lit(False)) if a.condition is not None else None

    def where(c: Column) -> Column:
        return c if test is None else F.when(test, c)

    names = [n for n in a.args if n != "*"]
    fs = [resolve(df, n) for n in names]
    if a.func == "count":
        if not fs:
            return F.count(where(F.lit(1)))
        some = F.lit(False)
        for f in fs:
            some = some | (f.text != "")
        return F.count(where(F.when(some, 1)))
    if a.func in ("row_any",) and not fs:
        return F.any_value(where(F.struct("*")), True)
    if not fs:
        raise QueryError(f"{a.func}() needs a field")
    f = fs[0]
    typed = F.nullif(f.column, F.lit("")) if isinstance(f.kind, T.StringType) else f.column
    if a.func == "count_empty":
        none = F.lit(True)
        for x in fs:
            none = none & (x.text == "")
        return F.count(where(F.when(none, 1)))
    if a.func in ("count_uniq", "count_uniq_hash"):
        key = uniq_key(df, a, ctx)
        return F.count_distinct(key) if a.func == "count_uniq" else F.approx_count_distinct(key, UNIQ_ERROR)
    if a.func in ("sum", "avg", "stddev"):
        return {"sum": F.sum, "avg": F.avg, "stddev": F.stddev_samp}[a.func](where(f.number))
    if a.func in ("min", "max"):
        return (F.min if a.func == "min" else F.max)(where(typed))
    if a.func == "median":
        return F.percentile(where(f.number), F.lit(0.5))
    if a.func == "quantile":
        if len(a.args) != 2:
            raise QueryError("quantile(p, field) takes a share and a field")
        return F.percentile(where(resolve(df, a.args[1]).number), F.lit(float(a.args[0])))
    if a.func == "values":
        return F.array_sort(F.collect_list(where(f.text)))
    if a.func == "uniq_values":
        return F.array_sort(F.collect_set(where(F.nullif(f.text, F.lit("")))))
    if a.func == "any":
        return F.any_value(where(F.nullif(f.text, F.lit(""))), True)
    if a.func == "row_any":
        return F.any_value(where(F.struct(*[x.column.alias(n) for x, n in zip(fs, names)])), True)
    if a.func == "sum_len":
        return F.sum(where(F.octet_length(f.text).cast("long")))
    raise QueryError(f"unknown statistic {a.func}")


def stats(df: DataFrame, by: tuple[tuple[str, str], ...], items: tuple[Aggregate, ...], ctx: Context) -> DataFrame:
    """All statistics in one pass, sketches beside exact counts in one of their own; a histogram stands alone, as it has a row for each bucket."""
    if any(a.func == "histogram" for a in items):
        if len(items) > 1:
            raise QueryError("histogram() has a row for each bucket and stands alone")
        groups = group_columns(df, by)
        a = items[0]
        value = resolve(df, a.args[0]).number
        rows = df.filter(value.isNotNull())
        rows = rows.filter(condition(rows, a.condition, ctx)) if a.condition is not None else rows
        return rows.groupBy(*groups, histogram_bucket(value).alias("bucket")).agg(F.count(F.lit(1)).alias(a.name))
    groups = group_columns(df, by)
    aggregate = lambda chosen: (df.groupBy(*groups) if groups else df).agg(*[column(df, a, ctx).alias(a.name) for a in chosen])
    hashed = [a for a in items if a.func == "count_uniq_hash"]
    if not hashed or not any(a.func == "count_uniq" for a in items):
        return aggregate(items)
    # Beside an exact count Spark keeps all else by group and value, so a sketch of 13 KB for each value: sketches are made apart.
    rest = aggregate([a for a in items if a not in hashed])
    keys = rest.columns[: len(groups)]
    own = [f"_k{k}" for k in range(len(groups))] + [f"_h{k}" for k in range(len(hashed))]
    while set(own) & set(rest.columns):
        own = [f"_{c}" for c in own]
    apart = aggregate(hashed).toDF(*own)
    same = reduce(Column.__and__, [F.col(quoted(k)).eqNullSafe(F.col(o)) for k, o in zip(keys, own)], F.lit(True))
    values = {a.name: F.col(o).alias(a.name) for a, o in zip(hashed, own[len(groups) :])}
    return (rest.join(apart, same) if groups else rest.crossJoin(apart)).select(*[quoted(k) for k in keys], *[values.get(a.name, F.col(quoted(a.name))) for a in items])
