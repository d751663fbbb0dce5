"""Pipes: each takes a DataFrame and gives one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..plans.ast import Pipe
from ..plans.compiler import Context, apply_filter, empty_like, ordering
from ..plans.parser import QueryError
from ..schema import fresh, quoted, resolve
from . import enumerate as en
from .stats import stats


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column whose name may hold dots, in its place or at the end."""
    if name in df.columns:
        return df.select(*[value.alias(name) if c == name else F.col(quoted(c)) for c in df.columns])
    return df.select(*[quoted(c) for c in df.columns], value.alias(name))


def fields(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return df if p["all"] else df.select(*[empty_like(df, f) for f in p["fields"]])


def delete(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    gone = set(p["fields"])
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def copy(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    for a, b in p["pairs"]:
        df = put(df, b, resolve(df, a).column)
    return df


def rename(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    for a, b in p["pairs"]:
        if a == b:
            continue
        df = put(df, b, resolve(df, a).column)
        df = df.select(*[quoted(c) for c in df.columns if c != a])
    return df


def filter_(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return apply_filter(df, p["filter"], ctx)


def replace(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    text = resolve(df, p["field"]).text
    if not p["limit"]:
        return put(df, p["field"], F.replace(text, F.lit(p["old"]), F.lit(p["new"])))
    parts = F.split(text, tx.literal(p["old"]), p["limit"] + 1)
    return put(df, p["field"], F.array_join(parts, p["new"]))


def replace_regexp(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    if p["limit"]:
        raise QueryError("replace_regexp has no limit here")
    return put(df, p["field"], F.regexp_replace(resolve(df, p["field"]).text, p["old"], tx.java_replacement(p["new"])))


def format_(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    parts = [resolve(df, x).text if is_field else F.lit(x) for is_field, x in tx.format_parts(p["template"])]
    return put(df, p["name"], F.concat(*parts) if parts else F.lit(""))


def arithmetic(df: DataFrame, e: tuple) -> Column:
    """A math expression in doubles; what is no number is NaN."""
    op = e[0]
    if op == "number":
        return F.lit(e[1])
    if op == "field":
        return F.coalesce(resolve(df, e[1]).number, F.lit(float("nan")))
    args = [arithmetic(df, x) for x in e[1:]]
    if op == "/":
        return F.when(args[1] == 0, F.when(args[0] == 0, F.lit(float("nan"))).otherwise(F.signum(args[0]) * F.lit(float("inf")))).otherwise(args[0] / F.nullif(args[1], F.lit(0.0)))
    if op == "%":
        return F.coalesce(args[0] % F.nullif(args[1], F.lit(0.0)), F.lit(float("nan")))
    if op in "+-*":
        return {"+": args[0] + args[1], "-": args[0] - args[1], "*": args[0] * args[1]}[op]
    if op == "^":
        return F.pow(*args)
    if op in ("max", "min") and len(args) > 1:
        return (F.greatest if op == "max" else F.least)(*args)
    return {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "exp": F.exp, "ln": F.ln, "max": lambda x: x, "min": lambda x: x}[op](args[0]).cast("double")


def math(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    for e, name in p["items"]:
        df = put(df, name, arithmetic(df, e))
    return df


def len_(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return put(df, p["name"], F.octet_length(resolve(df, p["field"]).text).cast("long"))


def unpack_json(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    """Named fields become columns of their own; without names they join the attribute map, below columns of the same name."""
    text = resolve(df, p["field"]).text
    if p["fields"]:
        for name in p["fields"]:
            path = "$['" + name.replace("'", "\\'") + "']"
            df = put(df, p["prefix"] + name, F.coalesce(F.get_json_object(text, path), F.lit("")))
        return df
    found = F.coalesce(F.from_json(text, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    if p["prefix"]:
        found = F.transform_keys(found, lambda k, v: F.concat(F.lit(p["prefix"]), k))
    own = F.col(quoted("log.attributes")) if "log.attributes" in df.columns else F.expr("cast(map() as map<string,string>)")
    own = F.coalesce(own, F.expr("cast(map() as map<string,string>)"))
    return put(df, "log.attributes", F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(found, k)), found))


def extract(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    pattern, names = tx.extract_parts(p["pattern"])
    if not names:
        raise QueryError("the pattern of extract names no field")
    text = resolve(df, p["field"]).text
    for k, name in enumerate(names, 1):
        df = put(df, name, F.regexp_extract(text, pattern, k))
    return df


def drop_empty_fields(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    """Empty texts become null, which row output leaves out."""
    kinds = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.select(*[(F.nullif(F.col(quoted(c)), F.lit("")) if isinstance(kinds[c], T.StringType) else F.col(quoted(c))).alias(c) for c in df.columns])


def unroll(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    """One row for each element of the fields' JSON arrays, side by side; shorter ones are filled with empty texts."""
    arrays = [F.coalesce(F.from_json(resolve(df, f).text, "array<string>"), F.array(F.lit(""))) for f in p["fields"]]
    row = fresh("_row", df)
    rows = df.select(*[quoted(c) for c in df.columns], F.explode_outer(F.arrays_zip(*[a.alias(f"a{k}") for k, a in enumerate(arrays)])).alias(row))
    for k, f in enumerate(p["fields"]):
        rows = put(rows, f, F.coalesce(F.col(row)[f"a{k}"], F.lit("")))
    return rows.drop(row)


def sort(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    out = df.orderBy(*ordering(df, p["keys"]))
    if p["offset"]:
        out = out.offset(p["offset"])
    return out.limit(p["limit"]) if p["limit"] is not None else out


def ranked(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    """first / last N, of all rows or of each partition."""
    keys = p["keys"] if p.name == "first" else tuple((k, not d) for k, d in p["keys"])
    order = ordering(df, keys, p.name == "last")
    if not p["partition"]:
        return df.orderBy(*order).limit(p["n"])
    window = Window.partitionBy(*[resolve(df, f).column for f in p["partition"]]).orderBy(*order)
    rank = fresh("_rank", df)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= p["n"]).drop(rank)


def limit(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return df.limit(p["n"])


def offset(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return df.offset(p["n"])


def uniq(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    columns = [empty_like(df, f) for f in p["fields"]]
    out = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("hits")) if p["hits"] else df.select(*columns).distinct()
    return out.orderBy(*map(quoted, p["fields"])).limit(p["limit"]) if p["limit"] is not None else out


def top(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    counted = df.groupBy(*[empty_like(df, f) for f in p["fields"]]).agg(F.count(F.lit(1)).alias("hits"))
    return counted.orderBy(F.desc("hits"), *map(quoted, p["fields"])).limit(p["n"])


def join(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    """Equi-join with a subquery's rows; which side is broadcast is left to statistics and adaptive execution."""
    right = ctx.run(p["query"])
    missing = [k for k in p["on"] if k not in right.columns]
    if missing:
        raise QueryError(f"the joined query has no field {missing[0]}")
    for k in p["on"]:
        if k not in df.columns:
            df = put(df, k, resolve(df, k).column)
    names = {c: fresh(f"_r{n}", df) for n, c in enumerate(right.columns)}
    right = right.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    test = F.lit(True)
    for k in p["on"]:
        test = test & (F.col(quoted(k)) == F.col(names[k]))
    joined = df.join(right, test, p["how"])
    added = {c: n for c, n in names.items() if c not in p["on"]}
    kept = [quoted(c) for c in df.columns if c not in {p["prefix"] + a for a in added}]
    return joined.select(*kept, *[F.col(n).alias(p["prefix"] + c) for c, n in added.items()])


def union(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return df.unionByName(ctx.run(p["query"]), allowMissingColumns=True)


def facets(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return en.facets(df, p["n"])


def field_names(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return en.field_names(df)


def field_values(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return en.field_values(df, p["field"], p["limit"])


def stats_(df: DataFrame, p: Pipe, ctx: Context) -> DataFrame:
    return stats(df, p["by"], p["items"], ctx)


PIPES = {
    "fields": fields, "delete": delete, "copy": copy, "rename": rename, "filter": filter_, "replace": replace, "replace_regexp": replace_regexp,
    "format": format_, "math": math, "len": len_, "unpack_json": unpack_json, "extract": extract, "drop_empty_fields": drop_empty_fields,
    "unroll": unroll, "stats": stats_, "sort": sort, "first": ranked, "last": ranked, "limit": limit, "offset": offset, "uniq": uniq, "top": top,
    "join": join, "union": union, "facets": facets, "field_names": field_names, "field_values": field_values,
}
