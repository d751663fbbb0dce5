from pathlib import Path

import pytest

from stratalog.operators import maintenance as mt
from stratalog.sources import io


@pytest.fixture
def few(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def rows(spark, n):
    return io.log_rows(spark.createDataFrame([(f'{{"_time": "{1704412800 + 3600 * k}", "_msg": "m{k}", "trace_id": "{k}"}}',) for k in range(n)], "value string"))


def tasks(root):
    return {p.name.split("-")[1] for p in Path(root).rglob("*.parquet")}


def test_tables_are_written_without_checksum_files(spark, tmp_path):
    root, left, merged = (str(tmp_path / n) for n in ("a", "b", "c"))
    io.write_table(rows(spark, 5), root)
    mt.rewrite(spark, root, left, [])
    mt.compact_table(spark, root, merged)
    for place in (root, left, merged):
        assert len(list(Path(place).rglob("*.parquet"))) == 5 and not list(Path(place).rglob(".part-*.crc"))
        assert sorted(r.body for r in io.read_table(spark, place).collect()) == [f"m{k}" for k in range(5)]


def test_more_rows_take_more_tasks_than_the_session_names(spark, few, tmp_path, monkeypatch):
    spark.range(0, 40).selectExpr("""concat('{"_time": "', 1704412800 + 3600 * id, '", "_msg": "m', id, '"}') AS value""").write.parquet(str(tmp_path / "lines"))
    lines, root, merged = spark.read.parquet(str(tmp_path / "lines")), str(tmp_path / "a"), str(tmp_path / "b")
    monkeypatch.setattr(io, "TASK_BYTES", 10_000, raising=False)
    io.write_table(io.log_rows(lines), root)
    monkeypatch.setattr(io, "TASK_BYTES", 4 << 20)
    mt.compact_table(spark, root, merged)
    for place in (root, merged):
        assert len(list(Path(place).rglob("*.parquet"))) == 40 and len(tasks(place)) > 2
