"""The parser, and semantics that hold whatever the data."""

from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.engine import Engine
from stratalog.functions.times import duration_ns, end_of, parse_time
from stratalog.plans.ast import And, InQuery, Leaf, Not, Or, Stream
from stratalog.plans.parser import QueryError, parse
from stratalog.sources import views

BROKEN = ["", "  ", "level:", "level:=", "(a", "a)", "* |", "* | stats", "* | stats count(", "* | sort", "* | limit x", "f:in(a", "f:nope(1)", 'f:"x', "* | fields", "{a=}", "f:~'(?=x)'", "* | top by", "f:value_type(dict)", "* | block_stats", "a:range[1,2", "* | join by (a)", "* | math a +"]


@pytest.mark.parametrize("text", BROKEN)
def test_broken_queries_raise(text):
    with pytest.raises(QueryError):
        parse(text)


def test_trees():
    assert parse("a b").filter == And((Leaf("_msg", "phrase", ("a",)), Leaf("_msg", "phrase", ("b",))))
    assert parse("a or b and c").filter == Or((Leaf("_msg", "phrase", ("a",)), And((Leaf("_msg", "phrase", ("b",)), Leaf("_msg", "phrase", ("c",))))))
    assert parse("!f:=x").filter == Not(Leaf("f", "exact", ("x",))) == parse("-f:=x").filter == parse("f:!=x").filter
    assert parse('f:="x"*').filter == parse('f:="x*"').filter == Leaf("f", "exact_prefix", ("x",))
    assert parse('f:="a \\"b\\" c"').filter == Leaf("f", "exact", ('a "b" c',))
    assert isinstance(parse("f:in(* | fields g)").filter, InQuery)
    assert parse("{a=b,c=~`d.*` or e!=f}").filter == Stream(((("a", "=", "b"), ("c", "=~", "d.*")), (("e", "!=", "f"),)))
    assert parse("_time:[2024-01-01T00:00:00Z, 2024-01-02) x").filter == And((Leaf("_time", "time_range", ("2024-01-01T00:00:00Z", "2024-01-02"), (True, False)), Leaf("_msg", "phrase", ("x",))))
    assert [p.name for p in parse("* | rm a | mv a b | head 3 | skip 2 | where x:>1 | count() | keep a").pipes] == ["delete", "rename", "limit", "offset", "filter", "stats", "fields"]
    assert parse("* | sort by (a desc, b) limit 5 offset 2").pipes[0].args == {"keys": (("a", True), ("b", False)), "limit": 5, "offset": 2}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab:="~|(){}[]<>!*, \\\'`', max_size=30))
def test_parser_never_breaks_otherwise(text):
    try:
        parse(text)
    except QueryError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_quoted_values_round_trip(text):
    quoted = '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    leaf = parse(f"f:i({quoted})").filter
    assert leaf == Leaf("f", "any_case_phrase", (text,))


def test_times():
    now = datetime(2024, 1, 20, 12, tzinfo=UTC)
    assert parse_time("now-1h30m", now) == datetime(2024, 1, 20, 10, 30, tzinfo=UTC) == parse_time("1h30m", now)
    at = datetime(2024, 1, 3, 12, tzinfo=UTC)
    assert {parse_time(x) for x in ("1704283200", "1704283200000", "1704283200000000", "1704283200000000000", 1704283200, "2024-01-03T12:00:00Z", "2024-01-03T13:00:00+01:00", "2024-01-03T12")} == {at}
    assert end_of("2024-01-03") == datetime(2024, 1, 3, 23, 59, 59, 999999, tzinfo=UTC)
    assert duration_ns("1.5s") == 1_500_000_000
    for bad in ("", "5x", "h"):
        with pytest.raises(ValueError):
            duration_ns(bad)


ROWS = [("1", "日本語", None), ("2", 'hello "world"', ""), ("3", "a_b ab a-b", "x"), ("4", None, "X"), ("5", "line\nbreak", "xy")]


def small(spark):
    return spark.createDataFrame(ROWS, "id string, _msg string, level string")


@pytest.mark.parametrize(
    "text, ids",
    [
        ('_msg:="日本語"', "1"), ('_msg:="hello \\"world\\""', "2"), ("world", "2"), ("ab", "3"), ("a_b", "3"), ("b", "3"), ("日本", ""), ("日本*", "1"),
        ('level:=""', "12"), ("level:*", "345"), ("NOT level:=x", "1245"), ("!level:*", "12"), ('level:i("x")', "34"), ("level:=x*", "35"), ("nothing:=\"\"", "12345"), ("nothing:*", ""),
        ('_msg:seq("line", "break")', "5"), ("_msg:len_range(0, 3)", "14"), ('level:in("", "x")', "123"), ("level:contains_any(x, X)", "34"), ("_msg:~`^a.*b$`", "3"),
    ],
)
def test_edge_filters(spark, text, ids):
    assert "".join(sorted(r.id for r in Engine(small(spark)).query(text).collect())) == ids


def test_cross_validation(spark, sf_dir):
    engine = Engine(views.logs(spark, sf_dir))
    n = lambda q: engine.query(f"{q} | count() n").first().n
    total = n("*")
    assert total == sum(r.n for r in engine.query("* | stats by (level) count() n").collect())
    assert total == n("level:=error") + n("NOT level:=error")
    assert total == sum(r.hits for r in engine.hits("*", "1h").collect()) == sum(r.hits for r in engine.field_values("level").collect())
    assert n("level:=error OR level:=view") == n("level:=error") + n("level:=view")
    assert n("_time:[2030-01-01, 2031-01-01]") == 0 == engine.query("*", start="2024-01-10", end="2024-01-02").count()


def test_stats_need_a_stats_pipe(spark):
    with pytest.raises(QueryError):
        Engine(small(spark)).stats_query("* | fields level")


def test_exact_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = Engine(views.logs(spark, sf_dir)).query("level:=error user_id:>10 | stats by (user_id) count() n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_nested_queries_do_not_cross_join(spark, sf_dir):
    df = Engine(views.logs(spark, sf_dir)).query("trace_id:in(level:=error | fields trace_id) | join by (trace_id) (* | stats by (trace_id) count() n) inner")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Cross" not in plan
