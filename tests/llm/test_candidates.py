from stratalog.llm import near_copies

from .test_near_copies import corpus
from .test_pipeline import brute_classes


def test_a_large_group_is_linked_once_not_under_each_key(spark, monkeypatch):
    made, keep = {}, near_copies.materialise

    def counted(df, name):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    rows = corpus(11, 1, 150)
    got = dict(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_classes(rows)
    assert sum(got[k] != want[k] for k in got) <= 0.02 * len(rows)
    # Under each of the 96 keys most of the group meets again.
    assert made["candidates"] <= near_copies.FIRST * made["nodes"]
