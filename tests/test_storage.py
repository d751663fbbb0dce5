"""Ingest, stored tables, maintenance and streams."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalog.engine import Engine
from stratalog.operators import maintenance as mt
from stratalog.operators import metadata as md
from stratalog.schema import LOGS_SCHEMA, flatten, resolve, severity, time_text
from stratalog.sources import io, manifest, views
from stratalog.streaming import ingest as st


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


EVENTS = [
    {"_time": "2024-01-05T10:00:00.123456789Z", "_msg": "one", "level": "INFO", "service.name": "a", "trace_id": "t1", "color": "red"},
    {"_time": "1704448800", "_msg": "two", "severity_number": "17", "service.name": "b", "host.name": "h"},
    {"_time": "2024-01-05T11:30:00Z", "_msg": "three", "service.name": "a", "empty": ""},
]


def test_log_rows(spark):
    rows = io.log_rows(lines(spark, EVENTS)).orderBy("body").collect()
    one, three, two = rows
    assert one.timestamp_unix_nano == 1704448800123456789 and two.timestamp_unix_nano == 1704448800 * 10**9
    assert (one.severity_text, two.severity_text, three.severity_text) == ("INFO", "ERROR", "")
    assert one["log.attributes"] == {"color": "red"} and three["log.attributes"] == {} and two["host.name"] == "h"
    assert one._stream == '{service.name="a"}' and one._stream_id == three._stream_id != two._stream_id
    assert len(one._stream_id) == 48
    assert rows[0].asDict().keys() == {f.name for f in LOGS_SCHEMA.fields}


def test_round_trip_and_deletes(spark, tmp_path):
    root = str(tmp_path / "logs")
    io.write_table(io.log_rows(lines(spark, EVENTS)), root)
    table = io.read_table(spark, root)
    assert {(r.dt, r.hour) for r in table.select("dt", "hour").collect()} == {("2024-01-05", 10), ("2024-01-05", 11)}
    engine = Engine(table)
    assert [r.body for r in engine.query("color:=red").collect()] == ["one"]
    assert [r.body for r in engine.query("_msg:=three", start="2024-01-05T11:00:00Z", end="2024-01-05T12:00:00Z").collect()] == ["three"]
    plan = engine.query("*", start="2024-01-05T11:00:00Z")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "hour" in plan.split("PartitionFilters")[1]
    stone = mt.Tombstone('service.name:="a"', datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 5, 11, tzinfo=UTC))
    assert sorted(r.body for r in mt.visible(table, [stone]).collect()) == ["three", "two"]
    after = mt.rewrite(spark, root, str(tmp_path / "after"), [stone])
    assert sorted(r.body for r in after.collect()) == ["three", "two"]
    io.write_table(io.log_rows(lines(spark, EVENTS)), root)
    assert io.list_files(spark, root).filter("dt = '2024-01-05' and hour = 10").count() == 2
    mt.compact_table(spark, root, str(tmp_path / "compact"))
    assert io.list_files(spark, str(tmp_path / "compact")).groupBy("dt", "hour").count().filter("count > 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 6
    io.write_csv(io.read_table(spark, root).select("body"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 6
    assert io.read_files(spark, []).count() == 0


def test_bulk_lines(spark):
    body = ['{"create":{"_index":"x"}}', '{"_msg":"a","_time":"1"}', "", '{"index": {}}', '{"_msg":"b"}']
    found = io.bulk_lines(spark.createDataFrame([(b,) for b in body], "value string"))
    assert sorted(r.body for r in io.log_rows(found).collect()) == ["a", "b"]


def test_broken_tombstones_raise(spark):
    with pytest.raises(ValueError):
        mt.visible(spark.createDataFrame([(1,)], "_time long"), [mt.Tombstone("a:(", datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC))])


def test_coverage():
    day = lambda n: datetime(2024, 1, n, tzinfo=UTC)
    stones = [mt.Tombstone("*", day(1), day(3)), mt.Tombstone("*", day(2), day(4)), mt.Tombstone("*", day(9), day(12))]
    assert abs(mt.coverage(stones, day(1), day(11)) - 0.5) < 1e-9
    assert mt.coverage([], day(1), day(2)) == 0.0 == mt.coverage(stones, day(2), day(2))


def test_fields(spark):
    df = spark.createDataFrame([("b", {"k": "r", "x": "1"}, {"k": "l", "body": "no"}, None)], "body string, `resource.attributes` map<string,string>, `log.attributes` map<string,string>, `scope.attributes` map<string,string>")
    get = lambda n: df.select(resolve(df, n).text.alias("v")).first().v
    assert [get(n) for n in ("body", "_msg", "k", "x", "log_attr:k", "resource_attr:x", "scope_attr:k", "none")] == ["b", "b", "r", "1", "l", "1", "", ""]
    assert flatten(df).first().attributes == {"k": "r", "x": "1"}


def test_severity_and_time(spark):
    rows = [("", 9), ("", 17), ("x", 1), (None, 24), ("", 0), ("", 25)]
    got = [r.v for r in spark.createDataFrame(rows, "t string, n int").select(severity(F.col("t"), F.col("n")).alias("v")).collect()]
    assert got == ["INFO", "ERROR", "x", "FATAL", "", ""]
    ns = [1704448800123456789, 1704448800120000000, 1704448800000000000]
    assert [r.v for r in spark.createDataFrame([(n,) for n in ns], "n long").select(time_text(F.col("n")).alias("v")).collect()] == ["2024-01-05T10:00:00.123456789Z", "2024-01-05T10:00:00.12Z", "2024-01-05T10:00:00Z"]


def test_retention(spark):
    rows = [(1, datetime(2024, 1, 1), {"app": ["api-1"]}), (2, datetime(2024, 1, 25), {"app": ["api-1"]}), (3, datetime(2024, 1, 1), {"app": ["db"]}), (4, datetime(2023, 1, 1), {})]
    files = spark.createDataFrame(rows, "id int, max_time timestamp_ntz, label_values map<string,array<string>>")
    now = datetime(2024, 1, 31)
    assert [r.id for r in mt.expired(files, [mt.Retention(10, (("app", "api-*"),)), mt.Retention(60, (("app", "d?"),))], now).collect()] == [1]
    assert sorted(r.id for r in mt.expired(files, [mt.Retention(10)], now).collect()) == [1, 3, 4]


def test_misc():
    assert mt.tenant_ids({"acme": (7, 1)}, "acme") == (7, 1) and mt.tenant_ids({}, "3:4") == (3, 4) and mt.tenant_ids({}, "") == (0, 0)
    with pytest.raises(ValueError):
        mt.tenant_ids({}, "nobody")
    assert [mt.zstd_level(h) for h in (1, 167, 168, 719, 720)] == [3, 3, 7, 7, 17] and mt.expected_files(0) == 1


def test_sketches(spark, sf_dir):
    logs = views.logs(spark, sf_dir)
    exact = logs.select("user_id").distinct().count()
    got = md.merged_estimate(md.sketches(logs, ["level"], "user_id")).first().distinct
    assert abs(got - exact) <= 0.05 * exact


def test_streamed_ingest(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text("\n".join(map(json.dumps, EVENTS)))
    far = (datetime.now(UTC) + timedelta(days=30)).isoformat()
    (source / "b.json").write_text(json.dumps({"_msg": "late", "_time": "2023-01-01T00:00:00Z"}) + "\n" + json.dumps({"_msg": "future", "_time": far}))
    for _ in range(2):  # the second run finds nothing new
        st.ingest(st.read_lines(spark, str(source)), root, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.body for r in io.read_table(spark, root).collect()) == ["late", "one", "three", "two"]


def test_streamed_windows_close(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select(F.col("ts").cast("timestamp").alias("_time"), F.col("event_type").alias("level")).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema("_time timestamp, level string").parquet(str(tmp_path / "rows"))
    closed = st.run_once(st.tumbling(rows, "1 hour", lateness="2 minutes"), "closed", "append")
    want = {(r["_time"], r.hits) for r in Engine(events.select(F.col("ts").cast("timestamp").alias("_time"))).hits("*", "1h").collect()}
    got = {(r["_time"], r.hits) for r in closed.collect()}
    assert got < want and len(want - got) == 1


def test_streamed_edges(spark, sf_dir, tmp_path):
    spans = views.spans(spark, sf_dir).drop("span.attributes")
    spans.write.parquet(str(tmp_path / "spans"))
    stream = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "spans"))
    st.graph_task(stream, str(tmp_path / "edges"), str(tmp_path / "check"), "90 days").awaitTermination()
    from stratalog.operators.traces import graph_of_edges, service_graph

    got = graph_of_edges(spark.read.parquet(str(tmp_path / "edges")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, service_graph(spans).collect()))


def test_edges_across_batches(spark, tmp_path):
    """Parent and child in different micro-batches, in either order; a pair too far apart in time is none."""
    at = lambda m: datetime(2024, 1, 5, 10, m)
    batches = [[("1", "", 3, "a", at(0)), ("4", "3", 2, "b", at(1))], [("2", "1", 2, "b", at(2)), ("3", "", 3, "a", at(3))], [("5", "1", 2, "c", at(59))]]
    schema = "span_id string, parent_span_id string, kind int, `service.name` string, _time timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        st.graph_task(stream, str(tmp_path / "edges"), str(tmp_path / "check"), "30 minutes").awaitTermination()
    edges = spark.read.parquet(str(tmp_path / "edges"))
    assert sorted((r.parent, r.child, r.callCount) for r in edges.filter("callCount > 0").collect()) == [("a", "b", 2)] and edges.select("batch").distinct().count() == 1


def test_newest_and_max_rows_on_stored_rows(spark, tmp_path):
    io.write_table(io.log_rows(lines(spark, EVENTS)), str(tmp_path / "logs"))
    table = io.read_table(spark, str(tmp_path / "logs"))
    assert [r.body for r in Engine(table).query("*", limit=2).collect()] == ["three", "one"]
    assert [r.body for r in Engine(table).query("*", limit=1, offset=2).collect()] == ["two"]
    assert Engine(table, max_rows=3).query("*").count() == 3
    with pytest.raises(Exception, match="3 result rows, 2 are allowed"):
        Engine(table, max_rows=2).query("*").collect()
    assert Engine(table, max_rows=1).query("* | stats count() n").first().n == 3


def test_clashing_names(spark):
    rows = spark.createDataFrame([("a", 1, 5, '["x","y"]'), ("a", 2, 6, "[]"), ("b", 3, 7, "[]")], "g string, _rank int, _r0 int, _row string")
    assert sorted(r["_rank"] for r in Engine(rows).query("* | first 1 by (_r0) partition by (g)").collect()) == [1, 3]
    assert Engine(rows).query("* | unroll by (_row)").count() == 4
    joined = Engine(rows).query("* | join by (g) (* | stats by (g) max(_r0) as top) inner").collect()
    assert sorted((r["_r0"], r.top) for r in joined) == [(5, 6), (6, 6), (7, 7)]


def test_eligible_and_default_retention(spark):
    rows = [("2024-01-05", 1, 0)] * 4 + [("2024-01-05", 2, 1)] * 2 + [("2024-01-05", 3, 0)] * 2 + [("2024-01-06", 23, 0)] * 9
    files = spark.createDataFrame(rows, "dt string, hour int, level int")
    now = datetime(2024, 1, 6, 23, 30)
    got = lambda **kw: sorted(map(tuple, mt.eligible(files, now, **kw).collect()))
    assert got() == [("2024-01-05", 1, 0)]
    assert got(rollup_hours=24) == [("2024-01-05", 1, 0), ("2024-01-05", 2, 1)]
    assert got(min_l0=2, min_age_hours=0) == [("2024-01-05", 1, 0), ("2024-01-05", 3, 0), ("2024-01-06", 23, 0)]
    old = spark.createDataFrame([(1, datetime(2024, 1, 1), {"app": ["x"]}), (2, datetime(2024, 1, 5), {})], "id int, max_time timestamp_ntz, label_values map<string,array<string>>")
    assert [r.id for r in mt.expired(old, [mt.Retention(30, (("app", "x"),))], datetime(2024, 1, 6), 0.5).collect()] == [2]


def test_span_compaction(spark, tmp_path):
    spans = [{"trace_id": t, "span_id": s, "name": "n", "start_time_unix_nano": "1704448800000000000", "duration": "5", "resource_attr:service.name": "a"} for t, s in (("t2", "1"), ("t1", "2"), ("t2", "3"))]
    for part in (spans[:2], spans[2:]):
        io.write_table(io.span_rows(lines(spark, part)), str(tmp_path / "spans"))
    mt.compact_table(spark, str(tmp_path / "spans"), str(tmp_path / "out"), spans=True, level=mt.zstd_level(1000))
    assert [r.span_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["2", "1", "3"]


def test_manifest(spark, tmp_path):
    root = str(tmp_path / "logs")
    io.write_table(io.log_rows(lines(spark, EVENTS)), root)
    assert manifest.files(spark, root).isEmpty() and manifest.refresh(spark, root) == 2 and manifest.refresh(spark, root) == 0
    rows = {r.hour: r for r in manifest.files(spark, root).collect()}
    assert rows[10].rows == 2 and rows[10].labels["service.name"] == {"a": 1, "b": 1} and rows[11].max_time.minute == 30 and rows[11].bytes > 0
    assert rows[10].fingerprint != rows[11].fingerprint
    assert [r.body for r in manifest.trace_rows(spark, root, "t1").collect()] == ["one"] and manifest.trace_paths(spark, root, "t2") == []
    # A file that is not described yet is read all the same.
    io.write_table(io.log_rows(lines(spark, [EVENTS[0] | {"_msg": "four", "_time": "2024-01-05T10:59:00Z", "trace_id": "t2"}])), root)
    assert [r.body for r in manifest.trace_rows(spark, root, "t2").collect()] == ["four"]
    assert manifest.refresh(spark, root) == 1 and len(manifest.trace_paths(spark, root, "t2")) == 1
    table, known = io.read_table(spark, root), manifest.files(spark, root)
    assert table.count() == 4  # the manifest's own files are no rows of the table
    # Two files of an hour: one inside the range is answered by the manifest, the other is scanned.
    span = datetime(2024, 1, 5, 10, 0, 0, 500_000), datetime(2024, 1, 5, 11)
    assert md.count_rows(known, table, *span).first().n == 1
    assert {(r["service.name"], r.n) for r in md.count_by(known, table, "service.name", *span).collect()} == {("a", 1)}
    assert [r.hour for r in manifest.files_with(known, "service.name", "b").collect()] == [10]


def test_manifest_label_cap(spark, tmp_path):
    rows = [{"_time": "1704448800", "_msg": "m", "service.name": f"s{k}", "level": "x"} for k in range(101)]
    io.write_table(io.log_rows(lines(spark, rows)), str(tmp_path / "t"))
    manifest.refresh(spark, str(tmp_path / "t"))
    known = manifest.files(spark, str(tmp_path / "t"))
    assert known.first().labels == {"severity_text": {"x": 101}} and manifest.files_with(known, "service.name", "none").count() == 1


def test_otlp_and_loki(spark):
    text = lambda v: {"stringValue": v}
    attr = lambda **kv: [{"key": k, "value": v} for k, v in kv.items()]
    record = {"timeUnixNano": "1704448800000000001", "severityNumber": 9, "body": text("hello"), "attributes": attr(color=text("red"), n={"intValue": "3"}), "traceId": "t", "spanId": "s"}
    logs = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": text("a")}, {"key": "color", "value": text("blue")}]}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [record, {"observedTimeUnixNano": "5", "severityText": "WARN"}]}]}]}
    one, two = io.log_rows(io.otlp_log_lines(lines(spark, [logs, {}]))).orderBy(F.desc("body")).collect()
    assert (one.timestamp_unix_nano, one.body, one.severity_text, one["service.name"], one.trace_id, one["scope.name"]) == (1704448800000000001, "hello", "INFO", "a", "t", "lib")
    assert one["log.attributes"] == {"color": "red", "n": "3"} and two.severity_text == "WARN" and two["log.attributes"] == {"color": "blue"}
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "p", "name": "get", "kind": 2, "startTimeUnixNano": "1704448800000000000", "endTimeUnixNano": "1704448800000000007", "attributes": attr(user=text("u")), "status": {"code": 2, "message": "bad"}}
    got = io.span_rows(io.otlp_span_lines(lines(spark, [{"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": text("a")}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}]}]}]))).first()
    assert (got.duration_ns, got["span.kind"], got["status.code"], got["status.message"], got["service.name"], got["span.attributes"], got.parent_span_id) == (7, 2, 2, "bad", "a", {"user": "u"}, "p")
    push = {"streams": [{"stream": {"service.name": "a", "env": "x"}, "values": [["1704448800000000000", "one"], ["1704448800000000001", "two", {"k": "v"}]]}, {"stream": {}, "values": []}]}
    body = spark.createDataFrame([(json.dumps(push),)], "value string")
    got = io.log_rows(io.loki_lines(body)).orderBy("timestamp_unix_nano").collect()
    assert [(r.body, r["service.name"], r["log.attributes"]) for r in got] == [("one", "a", {"env": "x"}), ("two", "a", {"env": "x", "k": "v"})]
