import random
import zlib
from collections import Counter

import numpy as np

from stratalog.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int, text string"


def corpus(n=1500, seed=3):
    r = random.Random(seed)
    plain = [c + v + d for c in "bcdfgl" for v in "aeiou" for d in "mnrst"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [r.choice(plain) for _ in range(60)]
        if toxic:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(["vileone", "vilething", "rotten"])
        rows.append((i, " ".join(words), "en", 0.5))
        if r.random() < 0.6:
            labels.append((i, 1, int(toxic), "label text"))
    return rows, labels


def test_scores_separate_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(9000, None, None, None), (9001, "", "en", None), (9002, "rotten vileone vilething " * 20_000, "en", None), (None, "rotten vileone vilething", None, None)]
    got = toxicity.toxicity(spark.createDataFrame(rows + extra + [rows[0]], DOCS), spark.createDataFrame(labels + [labels[0], (1, None, None, None), (None, 1, 1, "")], LABELS)).collect()
    assert len(got) == len(rows) + len(extra) + 1
    by = {g.doc_id: g for g in got}
    for i in range(1500):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].predicted == int(by[i].score >= 0.7)
    held = [g for k, g in by.items() if k is not None and k < 1500 and g.held_out]
    assert sum(g.predicted == int(g.doc_id % 5 == 0) for g in held) >= 0.97 * len(held)
    assert by[9000].score == by[9001].score < 0.5 < by[9002].score
    assert by[None].predicted == 1


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.toxicity(spark.createDataFrame([(1, "some text", "en", 0.0)], DOCS), none).collect()
    assert [(g.score < 0.5, g.predicted) for g in got] == [(True, 0)]
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).collect() == []


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows, _ = corpus()
    only_held = [(i, 1, 1, "") for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    weights, _ = toxicity.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame(only_held, LABELS), toxicity.fold("doc_id", 3) != 1)
    assert weights == ()


def test_risk_correction_beats_taking_unlabelled_as_negative():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    rows = [([0] if r.random() < 0.9 else []) + ([1] if r.random() < 0.5 else []) if t else ([0] if r.random() < 0.05 else []) + ([1] if r.random() < 0.5 else []) for t in y]
    known = [i for i in range(4000) if y[i] and r.random() < 0.5]
    w, b = toxicity.fit_nnpu([rows[i] for i in known] + rows, [True] * len(known) + [False] * 4000, 2, 0.3)
    score = 1 / (1 + np.exp(-np.array([b + sum(w[c] for c in x) for x in rows])))
    assert ((score > 0.5) == y).mean() > 0.9
    assert abs(score.mean() - 0.3) < 0.08


def test_scoring_equals_the_features():
    weights = (("rotten", 1.5), ("vile-", 0.5), ("vile-2", 0.25), ("vileo-", -0.125))
    m = toxicity.Model(weights, -1.0)
    for text in ("Rotten!", "vileone vilething", "vileone", "", None, "rotten rotten vileones vileonex"):
        z = -1.0 + sum(w for f, w in weights if f in toxicity.features(text))
        assert abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-12


def test_weights_do_not_depend_on_partitions(spark):
    rows, labels = corpus(600)
    r = random.Random(8)
    # Words of few positives each, and common words that a batch's positives often lack.
    rows = [(i, f"{t} rare{'abcdefghij'[i // 5 % 10]}x" if i % 5 == 0 else f"{t} usual{r.choice('abcdefgh')}", lang, s) for i, t, lang, s in rows]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    one, many = (toxicity.learn(docs.repartition(n, "doc_id"), labels) for n in (1, 200))
    assert one == many
    # The features that the rule names, by a plain count over all texts (the bounds hold all 600).
    toxic = {k for k, _, y, _ in [tuple(x) for x in labels.collect()] if y}
    found = [(k, toxicity.features(t)) for k, t, *_ in rows]
    p, u = (Counter(f for k, fs in found if k in toxic or every for f in fs) for every in (False, True))
    n, m = len(toxic), len(rows)
    rates = {f: (p[f] / n - u[f] / m, q * (1 - q) * (1 / n + 1 / m)) for f in p if p[f] >= toxicity.SEEN and (q := (p[f] + u[f]) / (n + m)) < 1}
    named = {f for f, (gap, var) in rates.items() if gap >= toxicity.EXCESS * (var + 1e-12) ** 0.5}
    assert {f for f, _ in one[0]} <= named and len(one[0]) > 0.8 * len(named) > 5
    assert any(f.startswith("rare") and f.endswith("x") for f in named)


def test_positives_that_are_not_in_the_table_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} of the text", "en", 0.0) for i in range(50)], DOCS)
    absent = spark.createDataFrame([(1000 + i, 1, 1, "") for i in range(20)] + [(i, 1, 0, "") for i in range(20)], LABELS)
    got = toxicity.toxicity(docs, absent).collect()
    assert len(got) == 50 and len({g.score for g in got}) == 1 and got[0].score < 0.05
    assert toxicity.drop_toxic(docs, *toxicity.learn(docs, absent)).count() == 50


def test_partly_absent_and_repeated_labels(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame(rows, DOCS)
    plain = toxicity.learn(docs, spark.createDataFrame(labels, LABELS))
    more = labels * 3 + [(50_000 + i, 1, 1, "") for i in range(3000)] + [(labels[0][0], 1, 0, "")]
    assert toxicity.learn(docs, spark.createDataFrame(more, LABELS)) == plain
    assert len(plain[0]) > 3


def test_fit_without_one_kind():
    for positive in ([True] * 3, [False] * 3, []):
        w, b = toxicity.fit_nnpu([[0], [1], []][: len(positive)], positive, 2, 0.25)
        assert w.tolist() == [0, 0] and abs(b - np.log(0.25 / 0.75)) < 1e-12


def test_risk_against_brute_force():
    r = np.random.default_rng(4)
    rows = [sorted(set(r.integers(0, 6, 3).tolist())) for _ in range(40)]
    w, b, prior = r.normal(size=6) * 3, -0.3, 0.2
    p, u = rows[:15], rows[15:]
    hit = [[1 / (1 + np.exp(-(b + sum(w[c] for c in x)))) >= toxicity.THRESHOLD for x in part] for part in (p, u)]
    want = prior * hit[0].count(False) / 15 + max(0, hit[1].count(True) / 25 - prior * hit[0].count(True) / 15)
    assert abs(toxicity.decision_risk(p, u, w, b, prior) - want) < 1e-12
    assert toxicity.chosen_decay(p[:2], u, 6, prior) == toxicity.DECAYS[0]
