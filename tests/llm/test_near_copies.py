import random

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import near_copies

from .test_pipeline import brute_classes


def noisy(r, base, k):
    words = base.split()
    for i in r.sample(range(len(words)), k):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, bases, copies, words=120):
    r = random.Random(seed)
    texts = []
    for b in range(bases):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(words))
        texts += [base] + [noisy(r, base, r.choice([0, 1, 1, 2, 2, 3, 9])) for _ in range(copies)]
    texts += ["one two", "One\ttwo ", "one two three four five six", "", " \n"]
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bases,copies,all_pairs,hot", [(30, 4, 24, 50_000), (3, 60, 2, 16)])
def test_components_equal_brute_force(spark, monkeypatch, bases, copies, all_pairs, hot):
    monkeypatch.setattr(near_copies, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(near_copies, "BLOCK_NODES", hot)
    rows = corpus(bases * 7 + copies, bases, copies)
    df = spark.createDataFrame(rows + [(None, None), (5, rows[0][1]), (5, rows[0][1])], "doc_id long, text string")
    got = [tuple(r) for r in near_copies.near_copies(df, hot_rows=hot).collect()]
    want = brute_classes([(5, rows[0][1]), *rows])
    assert len(got) == len(rows) + 3
    wrong = [(k, c, want[k]) for k, c in got if k is not None and want[k] != c]
    # Pairs right at the similarity may meet under no key: 3 in 100 by the parameters.
    assert len(wrong) <= 0.02 * len(rows)
    assert len(set(want.values())) < len(rows) - 10
    assert [c for k, c in got if k is None] == [min(k for k, t in rows if not t.strip())]


def test_recall_of_keys_and_bits():
    """Of pairs at a similarity near 0.8, how many pass the keys and the bit limit."""
    r = random.Random(9)
    masks = [sum((x % 2**64) << 64 * k for k, x in enumerate(m)) for m in near_copies.key_masks()]
    assert len(masks) == near_copies.TABLES and all(m.bit_count() == near_copies.KEY_BITS for m in masks)
    hits = total = 0
    while total < 300:
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(200))
        other = noisy(r, base, 4)
        one, two = (sum((f % 2**64) << 64 * k for k, f in enumerate(near_copies.sketch(t)[1:])) for t in (base, other))
        total += 1
        hits += ((one ^ two) % 2**128).bit_count() <= near_copies.MAX_BITS and any(not (one ^ two) & m for m in masks)
    assert hits >= 0.93 * total


def test_a_similarity_below_is_no_link(spark):
    r = random.Random(3)
    base = " ".join(f"w{r.randrange(3000)}" for _ in range(200))
    rows = [(1, base), (2, noisy(r, base, 1)), (3, noisy(r, base, 8)), (4, noisy(r, base, 8))]
    got = dict(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sketch():
    assert near_copies.sketch(None) == near_copies.sketch(" \n") == (0, 0, 0, 0, 0)
    assert near_copies.sketch("a b c d e a b c d e a b c d e")[0] == 5
    long = " ".join(str(i) for i in range(near_copies.BLOCK + 500))
    assert near_copies.sketch(long)[0] == near_copies.BLOCK + 496
    assert near_copies.sketch("A  b") == near_copies.sketch("a\tB")


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.near_copies(none).collect() == [] and near_copies.one_of_each(none).collect() == []


def test_joining_links_against_brute_force():
    r = random.Random(8)
    base = [f"s{k}" for k in range(40)]
    found = [set(base) - set(r.sample(base, r.randint(0, 6))) | {f"own{i}-{k}" for k in range(r.randint(0, 3))} for i in range(60)] + [set(), set()]
    number = {x: k for k, x in enumerate(sorted(set().union(*found)))}
    sets = pa.array([sorted(number[x] for x in f) for f in found], pa.list_(pa.int64()))
    nodes, roots = np.arange(100, 162), np.array([i // 3 for i in range(62)])
    a, b = near_copies.joining_links(nodes, roots, sets)
    similar = [(i, j) for i in range(62) for j in range(i) if len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j]) - 1e-9]

    def joined(edges):
        root = list(range(62))
        for i, j in [(i, 3 * (i // 3)) for i in range(62)] + edges:
            x, y = root[i], root[j]
            root = [x if z == y else z for z in root]
        return root

    links = [(i - 100, j - 100) for i, j in zip(a.tolist(), b.tolist())]
    assert all((max(x), min(x)) in similar for x in links) and len(links) < len(nodes)
    assert len(set(joined(links))) == len(set(joined(similar))) < 21
