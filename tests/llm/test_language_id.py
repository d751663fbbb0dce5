import random
import zlib

import numpy as np

from stratalog.llm import language_id

SCHEMA = "doc_id long, text string, lang string, score double"


def brute_phrases(text, sample):
    """Longest matches, one after the other."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and tuple(text[at : at + n]) in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def substrings(seq, longest):
    return {tuple(seq[i : i + n]) for i in range(len(seq)) for n in range(1, longest + 1) if i + n <= len(seq)}


def test_phrases_equal_brute_force():
    r = random.Random(1)
    p = language_id.CrossParser((("x", "abra cadabra abra"), ("y", "baab ba abab bba")))
    samples = [substrings(p.symbols(language_id.letters_only(t)).tolist(), 20) for t in ("abra cadabra abra", "baab ba abab bba")]
    texts = ["".join(r.choice("abrcd z.é") for _ in range(r.randint(0, 60))) for _ in range(200)]
    docs = [p.symbols(language_id.letters_only(t)) for t in texts]
    got = p.phrases(docs)
    assert got.tolist() == [[brute_phrases(d.tolist(), s) for s in samples] for d in docs]


def test_blocks_of_long_texts(monkeypatch):
    """Counts are those of one parse, wherever the blocks end."""
    r = random.Random(7)
    sample = "".join(r.choice("ab c") for _ in range(300))
    p = language_id.CrossParser((("x", sample), ("y", "abababababababababab cccc")))
    own = [substrings(p.symbols(language_id.letters_only(t)).tolist(), 40) for t in (sample, "abababababababababab cccc")]
    texts = ["ab" * 90, "abc" * 50, "", "a", "aab" * 31 + "z" + "ab" * 40] + ["".join(r.choice("abbc z") for _ in range(r.randint(0, 200))) for _ in range(40)]
    docs = [p.symbols(language_id.letters_only(t)) for t in texts]
    want = [[brute_phrases(d.tolist(), s) for s in own] for d in docs]
    for block in (1, 2, 3, 7, 16, 512):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert p.phrases(docs).tolist() == want


def test_symbols():
    assert language_id.letters_only("..A  b, 12 \u00df!") == "a b \u00df".encode()
    assert language_id.letters_only("..A  b, 12 !") == b"a b"
    assert language_id.letters_only("12 \u2003 !") == b""
    p = language_id.CrossParser((("x", "ab"),))
    assert p.symbols("a b\u00df".encode()).tolist() == [1, 0, 2, 0, 0]


def test_tiny_and_empty_samples_win_nothing():
    english = "the house of the water and the garden with the people of the land " * 20
    german = "das haus und der garten mit den leuten an dem wasser und dem land " * 20
    p = language_id.CrossParser((("de", german), ("empty", "12 34 !"), ("en", english), ("tiny", "ok")))
    assert p.languages == ["de", "en", "tiny"]
    names, scores = p.predict(["the people look at the water", "die leute sind in dem haus am wasser", "ok", None, "123"])
    assert names[:2] == ["en", "de"] and names[3:] == ["und", "und"] and scores[3:] == [0.0, 0.0]


def test_memory_of_a_large_alphabet():
    r = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    p = language_id.CrossParser((("zh", "".join(r.choice(letters) for _ in range(24_000))), ("en", "the house of the water " * 1000)))
    assert sum(t.nbytes for t in p.tables) < 300_000_000
    assert p.predict(["".join(letters[40:90]), "the water"])[0] == ["zh", "en"]


def test_rows(spark):
    words = {"en": "the of and house water with", "de": "der und von haus wasser mit", "fr": "le et de maison avec eau"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words[lang].split()) for _ in range(30)), lang, 0.0) for i, lang in enumerate(list(words) * 30)]
    rows += [(900, None, "en", None), (901, "12 34 !?", "en", None), (902, "", None, None), (None, "the of and water", None, None), (903, "der und von " * 20_000, None, None)]
    rows += [rows[0]]
    got = language_id.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for k, text, lang, _ in rows:
        g = by[k]
        assert 0 <= g.score <= 1
        assert g.held_out == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0)
        assert g.lang_pred == ("und" if k in (900, 901, 902) else "en" if k is None else "de" if k == 903 else lang)


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", ("x" if i % 2 else "y") if zlib.crc32(str(i).encode()) % 5 else "never", 0.0) for i in range(60)]
    assert {g.lang_pred for g in language_id.languages(spark.createDataFrame(rows, SCHEMA)).collect()} == {"x", "y"}


def test_empty(spark):
    assert language_id.languages(spark.createDataFrame([], SCHEMA)).collect() == []
    got = language_id.languages(spark.createDataFrame([(1, "text", None, 0.0)], SCHEMA)).collect()
    assert [(g.lang_pred, g.score) for g in got] == [("und", 0.0)]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(g.lang_pred == g.lang for g in got) >= 0.95 * len(got)
