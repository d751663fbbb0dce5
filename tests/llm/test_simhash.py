import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from stratalog.llm import simhash


def brute_print(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, t=4):
    fps = list(dict.fromkeys(prints))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= t:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for f, k in zip(prints, ids):
        if k is not None:
            least[find(f)].append(k)
    return [min(least[find(f)], default=None) for f in prints]


def test_fingerprint():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 9, 200):
        text = " ".join(r.choice(["Ab", "the", "É", "x" * 40, "日本"]) + r.choice(["", "\n", "\t", " "]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")
    long = " ".join(str(r.randrange(1000)) for _ in range(simhash.BLOCK + 500))
    assert simhash.fingerprint(long) == brute_print(long)


def test_every_pair_within_the_limit_shares_a_key():
    r = random.Random(4)
    keys = simhash.chain_keys()
    assert len(keys) <= 35 and all(26 <= k.bit_count() <= 30 for k in keys)
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not d & k for k in keys)


def test_chain_test_keeps_every_link():
    r = random.Random(5)
    a = np.array([r.getrandbits(64) for _ in range(4000)], dtype=np.uint64)
    d = np.array([sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(4000)], dtype=np.uint64)
    near = np.bitwise_count(d) <= 4
    assert simhash.viable(a, a ^ d)[near].all()
    assert (simhash.linked(a, a ^ d) == near).all()


def noisy(rng, base, k):
    words = base.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") * 3
    return " ".join(words)


@pytest.mark.parametrize("hot_rows", [8, 100_000])
def test_components_equal_brute_force(spark, hot_rows):
    r = random.Random(6)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " ", "one", "one two", "One  Two"] + [noisy(r, b, k % 3) for b in base for k in range(40)] + base * 3
    rows = [(1000 - i, t, "en", 1) for i, t in enumerate(texts)] + [(7, base[0], "en", 1), (7, base[0], "en", 1), (None, "one", None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, fp long"), hot_rows=hot_rows).collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    want = list(zip([k for k, *_ in rows], [f"{f:016x}" for f in prints], brute_components(prints, [k for k, *_ in rows])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) > 5


def test_chains_of_links(spark):
    fps = [0, 0b1111, 0b11111111, 1 << 40, (1 << 40) | (0b11111 << 20), (1 << 63) | 1]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert roots[0] == roots[15] == roots[255] == roots[1 << 40] == roots[signed[5][0]]
    assert signed[4][0] not in roots


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
