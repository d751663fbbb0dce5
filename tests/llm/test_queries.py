"""Registered queries: names, contract columns, and SQL where there is some."""

import pytest

from stratalog.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import connect, rows_of

#: Columns and types that each query's result begins with or holds.
CONTRACT = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_decontaminate": {"doc_id": "bigint", "item_ids": "array<bigint>"},
    "op9_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = df.count()
    source = spark.read.parquet(f"{sf_dir}/{'pages' if name == 'op10_html_extract' else 'documents'}.parquet").count()
    assert 0 < rows <= source if name == "op8_decontaminate" else rows == source


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = connect(sf_dir).execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_planted_passages_are_found(spark, sf_dir):
    """Documents that hold a whole benchmark item, word for word, and no others are reported."""
    import re

    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    items = {f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if any(i in f" {' '.join(words(r.text))} " for i in items)}
    assert want and {r.doc_id for r in QUERIES["op8_decontaminate"](spark, sf_dir).collect()} == want
