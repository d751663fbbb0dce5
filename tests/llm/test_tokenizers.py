import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from stratalog.llm import bpe_codec, token_count, token_store  # noqa: E402
from stratalog.llm.vocab import WordTable  # noqa: E402

WORD_END = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["aaaa", "a", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "é", "日本", "😀", "!!", "--", "_", "\x1c", "\x85", "İ", "ΑΣ", "the", "ation", "zzzz", "​", "ſ", "'S"]


def mixtures(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(n)]


def schema():
    return "doc_id long, text string, lang string, n_tokens long"


def edge_rows():
    return [(1, "It is a test.", "en", 9), (1, "It is a test.", "en", 9), (2, None, None, None), (3, "", "en", 1), (None, "x", "de", 2), (5, "word " * 30_000, "en", 0)]


def test_counts_equal_the_library():
    lib = tokenizers.Tokenizer.from_file(WORD_END)
    count = token_count.counter(WORD_END).count
    for t in mixtures(3000):
        assert count(t) == len(lib.encode(t, add_special_tokens=False)), repr(t)


def test_any_code_points_equal_the_library():
    """Random code points of all planes, among them those whose properties differ by Unicode version."""
    r = random.Random(21)
    ranges = [(0x20, 0x250), (0x300, 0x370), (0x370, 0x600), (0x900, 0x1400), (0x1C80, 0x1CFF), (0x2000, 0x2C60), (0xA640, 0xABFF), (0x10000, 0x1F000), (0x1F000, 0x1FC00), (0xE000, 0x10FFFF)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) if r.random() < 0.6 else r.choice("aB1 '.") for _ in range(r.randint(1, 12))) for _ in range(12_000)]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] + [chr(c) for c in range(0x1C80, 0x1C8F)] + ["a" + chr(c) + "b" for c in range(0xA7C0, 0xA7E0)]
    count, words = token_count.counter(WORD_END), tokenizers.Tokenizer.from_file(WORD_END)
    auto, raw = bpe_codec.TokenAutomaton(bpe_codec.vocabulary(BYTE_LEVEL)), tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    for t in texts:
        assert count.count(t) == len(words.encode(t, add_special_tokens=False)), ascii(t)
        assert auto.encode(t) == raw.encode(t, add_special_tokens=False).ids, ascii(t)
    assert count.vocab.disputed


def test_many_long_words(spark):
    lib = tokenizers.Tokenizer.from_file(WORD_END)
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.choice([5, 70, 900]))) for _ in range(60)) for _ in range(10)]
    for t in texts:
        assert token_count.counter(WORD_END).count(t) == len(lib.encode(t, add_special_tokens=False))
    assert all(len(w) <= 64 for w in token_count.counter(WORD_END).table)


def test_automaton_equals_the_library():
    lib = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    auto = bpe_codec.automaton(BYTE_LEVEL)
    for t in mixtures(3000) + ["x" + c * k for c in "a=- 0\n" for k in range(40)]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert auto.encode(t) == want, repr(t)
        assert auto.decode(want) == lib.decode(want, skip_special_tokens=False) == t


def test_transitions_are_compiled_once_and_looked_up(monkeypatch):
    lib = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    auto = bpe_codec.TokenAutomaton(bpe_codec.vocabulary(BYTE_LEVEL))
    words = [w for t in mixtures(200, 7) for w in auto.vocab.words(t)]
    want = [auto.word_ids(w.encode()) for w in words]
    assert len(auto.states) > 50 and len(auto.number) == len(auto.states)
    # Every transition that was crossed is in the table: nothing is compiled again.
    monkeypatch.setattr(auto, "_compile", None)
    assert [auto.word_ids(w.encode()) for w in words] == want
    monkeypatch.undo()
    monkeypatch.setattr(bpe_codec, "STATES", 20)
    auto._start()
    for w in words:
        assert auto.word_ids(w.encode()) == lib.encode(w, add_special_tokens=False).ids
        assert len(auto.states) <= 21


def test_gadgets_take_the_arcs_that_merges_forbid():
    """An arc (u, v) stands exactly if the library leaves the two tokens as they are."""
    lib = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    auto = bpe_codec.automaton(BYTE_LEVEL)
    r = random.Random(11)
    plain = [i for i, label in auto.labels.items() if label.isalpha() and label.isascii() and i in auto.birth]
    stands = 0
    for _ in range(3000):
        u, v = r.choice(plain), r.choice(plain)
        want = lib.encode((auto.labels[u] + auto.labels[v]).decode(), add_special_tokens=False).ids == [u, v]
        assert auto._arc(u, v) == want
        stands += want
    assert 100 < stands < 2900


def test_automaton_decodes_broken_utf8_like_the_library():
    lib = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    auto = bpe_codec.automaton(BYTE_LEVEL)
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 6))]
        assert auto.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_count_rows(spark):
    lib = tokenizers.Tokenizer.from_file(WORD_END)
    got = token_count.token_counts(spark.createDataFrame(edge_rows(), schema()), WORD_END).collect()
    want = [(k, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 2048) for k, t, _, _ in edge_rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_count.token_counts(spark.createDataFrame([], schema()), WORD_END).collect() == []


def test_digest_rows(spark):
    lib = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    df = spark.createDataFrame(edge_rows(), schema())
    got = bpe_codec.encode_digests(df, BYTE_LEVEL).collect()
    want = []
    for k, t, _, _ in edge_rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = bpe_codec.encode_documents(df, BYTE_LEVEL).collect()
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in full if r.doc_id) == sorted((w[0], w[1], t or "") for w, (_, t, _, _) in zip(want, edge_rows()) if w[0])
    assert bpe_codec.encode_digests(spark.createDataFrame([], schema()), BYTE_LEVEL).collect() == []


def test_words_come_back_after_a_table_is_full():
    made = []
    table = WordTable(lambda w: made.append(w) or w, limit=2)
    assert [table[w] for w in "abcab"] == list("abcab")
    assert made == ["a", "b", "c"]


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 7, 500, 5000):
        prints = token_store.key_hashes(list(range(n)))
        seeds, slots = token_store.perfect_hash(prints)
        assert sorted(slots.tolist()) == list(range(n))
        assert n == 0 or token_store.slot_of(prints, seeds, n).tolist() == slots.tolist()
        assert len(seeds) == max(1, -(-n // token_store.BUCKET_KEYS))


@pytest.mark.parametrize("shards", [1, 3])
def test_store_round_trip(spark, shards):
    lib = tokenizers.Tokenizer.from_file(WORD_END)
    rows = edge_rows() + [(k, t, "en", 0) for k, t in enumerate(mixtures(60, 5), 100)]
    got = token_store.stored_documents(spark.createDataFrame(rows, schema()), WORD_END, shards=shards).collect()
    ids = {(k, t): lib.encode(t or "", add_special_tokens=False).ids + [1] for k, t, _, _ in rows}
    want = sorted(((k, len(ids[k, t]), zlib.crc32(np.array(ids[k, t], "<u4").tobytes())) for k, t, _, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((k for k, *_ in rows), key=lambda k: -1 if k is None else k)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


def test_keyed_access(spark):
    lib = tokenizers.Tokenizer.from_file(WORD_END)
    folder = token_store.new_path(spark, "test-ids")
    rows = [(k, f"text number {k}", "en", 0) for k in range(0, 400, 2)] + [(8, "again", "en", 0)]
    shards = token_store.write_shards(spark.createDataFrame(rows, schema()), folder, WORD_END, shards=2).collect()
    opened = [token_store.Shard(folder, s.name) for s in shards]
    for k, t, _, _ in rows:
        found = [x.tolist() for s in opened for x in s.ids(k)]
        assert lib.encode(t, add_special_tokens=False).ids + [1] in found
    assert sum(len(s.ids(8)) for s in opened) == 2
    assert all(not s.ids(k) for s in opened for k in (1, 3, 999, None))
    manifest = spark.createDataFrame(shards)
    store = token_store.Store(folder, manifest)
    for k in (0, 8, 100, 398):
        assert [x.tolist() for x in store.ids(k)] == [x.tolist() for s in opened for x in s.ids(k)] != []
    assert store.ids(1) == store.ids(None) == store.ids(-5) == []


def test_a_lookup_reads_one_seed_and_one_slot(spark, monkeypatch):
    folder = token_store.new_path(spark, "test-reads")
    rows = [(k, f"text number {k}", "en", 0) for k in range(3000)] + [(7, "again", "en", 0), (None, "no key", "en", 0)]
    (row,) = token_store.write_shards(spark.createDataFrame(rows, schema()), folder, WORD_END, shards=1).collect()
    assert (row.null_first, row.first_key, row.last_key) == (True, 0, 2999)
    shard, read = token_store.Shard(folder, row.name), []
    plain = shard._read
    monkeypatch.setattr(shard, "_read", lambda at, size: read.append(size) or plain(at, size))
    for k, more in ((0, []), (1234, []), (2999, []), (None, []), (7, [16]), (-1, [])):
        read.clear()
        shard.find(k)
        assert read == [4, token_store.SLOT.itemsize, *more]
    assert len(shard.find(7)) == 2 and len(shard.find(None)) == 1 and shard.find(-1) == []


def test_a_wrong_index_shows(spark):
    folder = token_store.new_path(spark, "test-wrong")
    rows = [(k, f"text number {k}", "en", 0) for k in range(50)]
    (row,) = token_store.write_shards(spark.createDataFrame(rows, schema()), folder, WORD_END, shards=1).collect()
    shard = token_store.Shard(folder, row.name)
    assert len(list(shard.find_all())) == 50
    path = f"{shard.path}.idx"
    raw = bytearray(open(path, "rb").read())
    raw[shard.at_slots] ^= 1  # a fingerprint
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="does not lead"):
        list(token_store.Shard(folder, row.name).find_all())


def test_empty_store(spark):
    assert token_store.stored_documents(spark.createDataFrame([], schema()), WORD_END).collect() == []


def test_constant_text(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    assert {r.n_tokens for r in token_count.token_counts(df, WORD_END).collect()} == {3}
