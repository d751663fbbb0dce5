"""Inputs that the second round's findings were about: odd texts, long tables, and what a query makes Spark do."""

import time
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stratalog import queries
from stratalog.engine import Engine
from stratalog.functions import text as tx
from stratalog.sources import io, manifest, views

from .oracle import duckdb, rows_of


def same_as_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def write_events(folder, first, n):
    ids = list(range(first, first + n))
    stamps = pa.array([datetime(2024, 1, 1 + k % 28, k % 24) for k in range(n)], pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": ids, "ts": stamps, "user_id": [k % 7 for k in ids], "event_type": ["view" if k % 2 else "error" for k in ids], "value": [1.5] * n, "props": ['{"k": 1}'] * n}), f"{folder}/events.parquet")


def test_eligible_after_january(spark, tmp_path):
    write_events(tmp_path, 400_000, 2000)  # in February
    same_as_sql(spark, tmp_path, "c1_eligible", "events")


def test_tokens_of_odd_texts(spark, tmp_path):
    texts = ["one two One", "", "! ?", "a b", None, "ΣΑΣ ΟΔΟΣ οδοσ ΟΔΟΣ. οδος", "İstanbul i̇stanbul istanbul", "xࡰy", "Ɤz ɤz", "\U00031350\U00031350 q", "ÀÉ àé"]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": texts, "source": ["s"] * n, "lang": ["en"] * n, "n_chars": [1] * n}), tmp_path / "documents.parquet")
    same_as_sql(spark, tmp_path, "l_tokens", "documents")


def test_sketch_beside_an_exact_count(spark, sf_dir):
    both = Engine(views.logs(spark, sf_dir)).query("* | stats by (level) count_uniq_hash(user_id) a, count_uniq(user_id) b, count_uniq_hash(user_id, k) if (duration:>50) c")
    alone = Engine(views.logs(spark, sf_dir)).query("* | stats by (level) count_uniq_hash(user_id) a, count_uniq_hash(user_id, k) if (duration:>50) c")
    assert {(r.level, r.a, r.c) for r in both.collect()} == {(r.level, r.a, r.c) for r in alone.collect()}
    assert both.columns == ["level", "a", "b", "c"] and both.filter("abs(a - b) > 0.1 * b").isEmpty()
    # No aggregation has a sketch and a value it is counted of as keys.
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "partial_approx_count_distinct" in x and "partial_count" in x or "merge_approx_count_distinct" in x]
    total = Engine(views.logs(spark, sf_dir)).query("* | stats count_uniq_hash(user_id) a, count_uniq(user_id) b").first()
    assert abs(total.a - total.b) <= 0.1 * total.b


def test_sequence_reads_a_text_once(spark):
    texts = ["of the " * 20_000, "of the " * 20_000 + "was", "the was of", "of of the the was", "of thewas the wash", "ofthe of\nthe\nwas", "was the of the was"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    began = time.monotonic()
    assert [r.k for r in rows.filter(tx.has_sequence(F.col("t"), ["of", "the", "was"])).orderBy("k").collect()] == [1, 3, 5, 6]
    assert time.monotonic() - began < 60


def test_rows_are_parsed_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame([('{"_msg":"a"}',), ("[1]",), (None,), ("{",)], "value string")
    assert plan(io.log_rows(lines)).count("from_json(") == 1
    assert [r.body for r in io.log_rows(lines).collect()] == ["a"]
    assert plan(io.mapped_rows(io.otlp_log_maps(lines))).count("from_json(") == 1


def test_row_queries_do_without_the_manifest(spark, tmp_path):
    write_events(tmp_path, 0, 2000)
    same_as_sql(spark, tmp_path, "s15_write_read", "events")
    root = queries._root(spark, str(tmp_path))
    assert manifest.files(spark, root).isEmpty()
    same_as_sql(spark, tmp_path, "m11_manifest_rows", "events")
    assert manifest.files(spark, root).count() == 6


def test_refresh_of_a_new_table_lists_its_root(spark, tmp_path, monkeypatch):
    read, asked = manifest.read, []
    monkeypatch.setattr(manifest, "read", lambda s, root, paths, *a: asked.append(len(paths)) or read(s, root, paths, *a))
    root = str(tmp_path / "t")
    lines = lambda hours: spark.createDataFrame([(f'{{"_time":"{1704448800 + 3600 * h}","_msg":"m","trace_id":"t{h}"}}',) for h in hours], "value string")
    io.write_table(io.log_rows(lines(range(5))), root)
    assert manifest.refresh(spark, root) == 5
    io.write_table(io.log_rows(lines([2, 9])), root)
    assert manifest.refresh(spark, root) == 2 and asked == [1, 2]
    known = manifest.files(spark, root)
    assert known.count() == 7 and known.agg(F.sum("rows")).first()[0] == 7 and manifest.traces(spark, root).count() == 7
