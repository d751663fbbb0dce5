import math
import random
import re
from collections import Counter

import pytest

from stratalog.llm import decontaminate, license_scan, quality_rules

SCHEMA = "doc_id long, text string, lang string, n_words long"
SPACE = " \t\n\x0b\x0c\r"


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_counts(text):
    words = split_words(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def odd_texts():
    r = random.Random(8)
    made = ["".join(r.choice(["a", "b", "the ", " ", "\n", "\t", "## ", "é", "😀 ", "x\n", "\x0b", " "]) for _ in range(r.randint(0, 150))) for _ in range(150)]
    return [None, "", "   ", "\n\n", "a a a", "a a a a", "a b c a b c", "Line\nLine\n\nLine \n", "|" * 40, "word " * 30_000] + made


def test_text_counts_equal_brute_force(spark):
    rows = [(i, t, "en", 0) for i, t in enumerate(odd_texts())] + [(1, "", None, None), (None, "a b", None, None)]
    got = quality_rules.text_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((k, *brute_counts(t)) for k, t, *_ in rows), key=str)
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got), key=str) == want


def test_windows_whose_hashes_meet(spark, monkeypatch):
    """With a hash of two values nearly all windows meet; the counts stay exact."""
    monkeypatch.setattr(quality_rules, "WINDOW_HASH", "length(words[i]) % 2")
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "dd", "e"]) for _ in range(r.randint(0, 40))) for _ in range(120)] + [None, "a b", "a b c a b c"]
    got = quality_rules.text_counts(spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {g.doc_id: g.n_repeat_words for g in got} == {i: brute_counts(t)[-1] for i, t in enumerate(texts)}


def test_kept_equals_a_plain_posterior(spark):
    """Votes, EM and the decision once more in plain Python."""
    r = random.Random(19)
    rows = [(i, good_text(r, r.choice([30, 90, 200])) if r.random() < 0.8 else "## ".join(good_text(r, 60).upper().split()), "en", 0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    voted, votes = quality_rules._voted(quality_rules.text_counts(df))
    found = {v.doc_id: tuple(v[c] for c in votes) for v in voted.collect()}
    base, up, down = quality_rules.fit(sorted(Counter(found.values()).items()))
    for g in quality_rules.quality(df).collect():
        odds = base + sum(u if v > 0 else d if v < 0 else 0 for v, u, d in zip(found[g.doc_id], up, down))
        n, *_, rep = brute_counts(rows[g.doc_id][1])
        assert g.kept == (n >= 50 and 100 * rep <= 50 * n and 1 / (1 + math.exp(-odds)) >= quality_rules.KEEP)


def good_text(r, n=120):
    return " ".join(r.choice("the of and to in is".split() if r.random() < 0.4 else ["house" + c + d for c in "abcdef" for d in "klmnop"]) for _ in range(n))


def test_kept(spark):
    r = random.Random(9)
    rows = [(i, good_text(r), "en", 0) for i in range(150)]
    junk = [" ".join(f"{w}{r.choice(['###', '$$$'])}" for w in good_text(r).split()) for _ in range(25)]
    junk += ["\n".join([good_text(r, 12).upper()] * 9) for _ in range(25)]
    rows += [(1000 + i, t, "en", 0) for i, t in enumerate(junk)] + [(2000, None, None, None), (2001, "", "en", 0), (None, good_text(r), None, None)]
    got = {g.doc_id: g for g in quality_rules.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(150)) and got[None].kept
    assert not any(got[1000 + i].kept for i in range(50))
    for k, text, *_ in rows:
        n, _, _, _, rep = brute_counts(text)
        assert got[k].base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (got[k].kept and got[k].base_failed)


def test_em_finds_rates_of_its_model():
    r = random.Random(10)
    on_good, on_bad, votes = [0.97, 0.9, 0.95, 0.8], [0.8, 0.7, 0.9, 0.6], Counter()
    for _ in range(30_000):
        good = r.random() < 0.8
        votes[tuple(0 if r.random() < 0.2 else (1 if r.random() < g else -1) if good else (-1 if r.random() < b else 1) for g, b in zip(on_good, on_bad))] += 1
    base, up, down = quality_rules.fit(sorted(votes.items()))
    assert abs(1 / (1 + math.exp(-base)) - 0.8) < 0.03
    for u, d, g, b in zip(up, down, on_good, on_bad):
        assert abs(u - math.log(g / (1 - b))) < 0.3 and abs(d - math.log((1 - g) / b)) < 0.3
    assert quality_rules.fit([]) == (0.0, [], [])


def test_quality_empty(spark):
    assert quality_rules.quality(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    found = [(i, label) for p, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def license_texts():
    r = random.Random(11)
    parts = ["MIT", "mit", "License", "license", "Apache", "general", "Public", "GNU", "licenKe", "lİcense", "the", ",", "/", "\n", "-", "2.0", "é", "MİT", "ſ"]
    made = ["".join(r.choice(parts) + r.choice([" ", " ", "", ", "]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    return [None, "", "...", "MIT License", "x mit-license MIT LICENSE y", "licence", "word " * 20_000 + "mit license"] + made


def test_base_columns_equal_brute_force(spark):
    rows = [(i, t, "en", 0) for i, t in enumerate(license_texts())] + [(3, "MIT License", "en", 0), (None, "apache license", None, None)]
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((k, *brute_licenses(t)) for k, t, *_ in rows), key=str)
    assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=str) == want
    for g in got:
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1 and (g.score > 0) == bool(g.labels)
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Licensed under CC BY 4.0.", "cc-by-4.0"),
        ("Redistribution and use in source and binary forms, with or without modification, are allowed provided that the following conditions are met:", "bsd"),
        ("Redistribution of water in source and binary forms is unlike it.", ""),
        ("Permission to use a garden.", ""),
        ("GNU Lesser General Public License", "gpl"),
    ],
)
def test_templates(spark, text, labels):
    df = spark.createDataFrame([(1, "Some words before it. " + text + " And after.", "en", 0)], SCHEMA)
    assert license_scan.scan(df).first().labels == labels


def test_anchors_are_the_rarest_words():
    index = license_scan.Index()
    words = "licensed under the mozilla license".split()
    assert words[index.rarest(words, 1)[0]] == "mozilla"


def items_and_docs():
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(14, 60))) for i in range(30)]
    docs, want = [], set()
    for k in range(120):
        base = text(r.randint(30, 300)).split()
        if k % 3 == 0:
            item, passage = items[k % 30]
            words = passage.split()
            if k % 2:  # every seventh word differs
                words = [w if j % 7 else "changed" for j, w in enumerate(words)]
            at = r.randrange(len(base))
            base[at:at] = words
            want.add((k, item))
        elif k % 3 == 1:  # a short run of an item is no overlap
            base[5:5] = items[k % 30][1].split()[:7]
        docs.append((k, (", " if k % 2 else " ").join(base).upper() if k % 4 == 0 else " ".join(base), "en", 0))
    return items, docs, want


@pytest.mark.parametrize("limits", [{}, {"MAX_VOCABULARY": 0, "MAX_BROADCAST": 0}])
def test_overlaps(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    items, docs, want = items_and_docs()
    docs += [(500, None, None, None), (501, "", "en", 0), (None, items[3][1], "en", 0), (502, " ".join([items[2][1]] * 50), "en", 0), docs[0]]
    items += [(900, None), (901, ""), (902, "two words"), (77, items[2][1])]
    want |= {(None, 3), (502, 2), (502, 77)} | {(k, 77) for k, i in want if i == 2}
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    words = {k: decontaminate_words(t) for k, t, *_ in docs}
    texts = {k: decontaminate_words(t) for k, t in items}
    for r in found:
        size = r.last_word - r.first_word + 1
        assert any(sum(a == c for a, c in zip(words[r.doc_id][r.first_word : r.last_word + 1], texts[r.item_id][j : j + size])) == r.n_match for j in range(len(texts[r.item_id])))
    rows = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, i) for r in rows for i in r.item_ids} == want and len(rows) == len({k for k, _ in want})
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, *_ in docs if (k not in {x for x, _ in want}))


def decontaminate_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def test_overlaps_empty(spark):
    d, b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, b).collect() == []
    one = spark.createDataFrame([(1, "some text here", "en", 0)], SCHEMA)
    assert decontaminate.contaminated(one, b).collect() == []
    assert decontaminate.clean(one, b).count() == 1


def test_short_items_are_found_word_for_word(spark):
    docs = [(1, "before it Alpha, beta gamma delta and after", "en", 0), (2, "alpha beta other delta gamma", "en", 0), (3, "one two three four five six and", "en", 0), (4, "two words here", "en", 0)]
    items = [(1, "alpha beta gamma delta"), (2, "one two three four five six"), (3, "two words"), (4, "alpha beta gamma delta epsilon")]
    found = decontaminate.overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((f.doc_id, f.item_id, f.first_word, f.last_word) for f in found) == [(1, 1, 2, 5), (3, 2, 0, 5)]


@pytest.mark.parametrize("every", [4, 5, 6, 9])
def test_regular_substitution_is_hit(spark, every):
    r = random.Random(every)
    items = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(40))) for i in range(12)]
    docs = [(i, "some words before " + " ".join(w if (j + i) % every else f"x{j}" for j, w in enumerate(t.split())), "en", 0) for i, t in items]
    found = decontaminate.overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(f.doc_id, f.item_id) for f in found} == {(i, i) for i, _ in items}
