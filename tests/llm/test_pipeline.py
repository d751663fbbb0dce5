import hashlib
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

from stratalog.llm import decontaminate, near_copies, quality_rules, storage, toxicity  # noqa: E402
from stratalog.llm.queries import vocab_file  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(storage.materialise(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "encoding"]


def test_each_stage_does_what_its_operator_says(spark, sf_dir, stages):
    docs, good, civil, single, clean = stages
    assert ids(good) == sorted(r.doc_id for r in quality_rules.quality(docs).filter("kept").collect())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(good, labels).collect()
    assert ids(civil) == sorted(r.doc_id for r in scored if not r.predicted)
    assert ids(single) == sorted(set(brute_classes([(r.doc_id, r.text) for r in civil.collect()]).values()))
    bad = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert bad and ids(clean) == sorted(set(ids(single)) - bad)
    assert len(docs.collect()) > len(good.collect()) > len(civil.collect()) > len(single.collect()) > len(clean.collect()) > 50


def test_run_equals_the_library(spark, sf_dir, stages):
    lib = tokenizers.Tokenizer.from_file(vocab_file("byte_bpe_50k.json"))
    want = []
    for r in stages[-1].collect():
        found = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def shingles(text, width=5):
    words = re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    words = [w for w in words if w]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_classes(rows, similarity=0.8):
    """id -> least id of its component, by the similarity of all pairs of shingle sets."""
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(sets)}


ROWS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def test_rows_with_nulls_and_repeats(spark):
    text = " ".join(f"the house{a}{b} garden{b}{a}" for a in "bcdfg" for b in "aeiouklmn")
    rows = [(1, text, None, None, None, 1), (1, text, None, None, None, 1), (2, None, None, None, None, 2), (None, text + " more", "en", "s", 3, 3), (5, "", "en", "s", 0, 4)]
    rows += [(100 + i, f"no{i} " + text.replace("house", f"x{i}y"), "en", "s", 0, 9) for i in range(30)]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted((str(r.doc_id), r.extra) for r in quality_rules.kept_rows(df).collect() if r.extra < 9) == [("1", 1), ("1", 1), ("None", 3)]
    df = df.filter("extra < 9")
    assert {r.doc_id for r in toxicity.drop_toxic(df, (("the", 9.0),), 0.0).collect()} == {2, 5}
    one = near_copies.one_of_each(df)
    assert one.columns == df.columns
    # Both wordless texts are one class; the near copy and its null id fall to document 1.
    assert [r.doc_id for r in one.orderBy("doc_id").collect()] == [1, 2] or [r.doc_id for r in one.orderBy("doc_id").collect()] == [None, 1, 2]
    assert near_copies.one_of_each(df.filter("false")).collect() == []
    assert quality_rules.kept_rows(df.filter("false")).collect() == []


@pytest.mark.parametrize("most", [0, 10])
def test_drop_ids(spark, monkeypatch, most):
    monkeypatch.setattr(storage, "BROADCAST_IDS", most)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    assert [r.text for r in storage.drop_ids(df, spark.createDataFrame([(2,), (None,), (2,)], "x long")).collect()] == ["a"]


def test_clear(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    df = storage.materialise(spark.range(3).toDF("a"), "x")
    assert df.count() == 3 and list(tmp_path.rglob("*.parquet"))
    storage.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_shared_folder_is_the_sessions_own(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = storage.shared_dir(spark)
    assert found.startswith("file:///") and found.removeprefix("file://") == (named or storage.LOCAL_FOLDER).removeprefix("file://").rstrip("/")


def prose(seed, n=60):
    return " ".join(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:6] for i in range(n))


def test_one_of_each_keeps_unrelated_texts_of_one_id(spark):
    a, b, c, d, e, f = (prose(k) for k in "abcdef")
    rows = [(None, b), (None, c), (None, a), (None, c), (1, a), (7, d), (7, e), (7, e), (3, d), (9, f), (9, f + " "), (None, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, i) for i, (k, t) in enumerate(rows)], ROWS)
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in near_copies.one_of_each(df).collect()), key=str)
    assert got == sorted([(None, b), (None, c), (1, a), (7, e), (3, d), (9, f), (None, "")], key=str)


def test_clean_keeps_unrelated_texts_of_one_id(spark):
    item = prose("item", 20)
    rows = [(None, prose("a")), (None, prose("b") + " " + item), (None, None), (4, prose("c")), (4, item + " " + prose("d")), (4, prose("e")), (5, item), (5, item)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, i) for i, (k, t) in enumerate(rows)], ROWS)
    got = decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == df.columns
    assert sorted(r.extra for r in got.collect()) == [0, 2, 3, 5]


def test_clashing_names_of_columns(spark):
    a, b = prose("a"), prose("b")
    odd = ["_gone0", "_gone0_", "_GONE1_", "_shared", "_hash", "_id", "node", "k", "i", "h", "kind", "n", "root", "stays", "w", "f", "t"]
    rows = [(1, a, *odd), (1, a, *odd), (2, a, *odd), (3, b, *odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in odd))
    items = spark.createDataFrame([(1, prose("b", 20))], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    for out, want in [
        (near_copies.one_of_each(df), [1, 3]),
        (decontaminate.clean(df, items), [1, 1, 2]),
        (toxicity.drop_toxic(df, *toxicity.learn(df, labels)), None),
        (quality_rules.kept_rows(df), None),
        (storage.drop_ids(df, spark.createDataFrame([(2,)], "x long")), [1, 1, 3]),
    ]:
        assert out.columns == df.columns
        got = [tuple(r) for r in out.collect()]
        assert all(r[2:] == tuple(odd) for r in got)
        assert want is None or sorted(r[0] for r in got) == want
