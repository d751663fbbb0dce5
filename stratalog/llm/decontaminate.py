"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of words: hashed are the words
under its ones, words under its zeros may differ.  The seeds' hashes of the
benchmark items and of the documents are joined; a hit names an item and the
diagonal (document place minus item place) on which the two would lie over
each other.  Each diagonal is then verified: item and document are compared
word by word, a matching word counts 1, a differing one -2, and the best
stretch must hold at least `MIN_WORDS` matching words, or `MIN_SHARE` of an item shorter
than that asks for.

Words are runs of letters and digits (all characters beyond ASCII count as
letters), lower-cased.  Windows with a word that no item has cannot hit and
are not hashed; that test needs the items' vocabulary, which goes into the
plan up to `MAX_VOCABULARY` words, beyond that every window is hashed.  The
items' hashes are broadcast up to `MAX_BROADCAST` rows, beyond that the join
shuffles.

Defined results: documents without an overlap have no row; null and short
texts never overlap; items of `SHORT` to 6 words, fewer than the seeds span,
are found where they stand word for word, still shorter ones never, as they
stand everywhere; texts of any length are searched whole; of several equally
good stretches on a diagonal the first is reported; rows that repeat an id are
reported under it once; repeated items are reported under each of their ids; a
null id is reported as null; an empty table gives no rows; other columns are
not read.

The seeds ignore every 3rd to 6th word or so: an item with each 4th word (or
rarer) substituted is hit wherever it is 12 words long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_IDS, drop_rows, materialise

#: Fixed masks: six words of windows of 7 to 10.
SEEDS = ("1111101", "1111011", "1110111", "1101000111")
#: Words of the shortest items that are looked for.
SHORT = 4
MIN_WORDS = 12
MIN_SHARE = 0.8
MISMATCH = 2
MAX_VOCABULARY = 100_000
MAX_BROADCAST = 500_000
#: What parts words after lower-casing.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), PARTS), lambda w: w != "")


def _seed_hashes(known: bool, short: list[int], whole: bool) -> Column:
    """SQL over `w` (words) and, if `known`, `f` (word is in the vocabulary): array of (h, i) for all seeds.

    For each length in `short` all windows of it are hashed, or if `whole` only texts of just that length.
    """
    parts = []
    masks = [(seed, f"size(w) >= {len(seed)}") for seed in SEEDS]
    masks += [("1" * n, f"size(w) {'=' if whole else '>='} {n}") for n in short]
    for k, (seed, test) in enumerate(masks):
        ones = [j for j, c in enumerate(seed) if c == "1"]
        words = ", ".join(f"w[i + {j}]" for j in ones)
        places = f"if({test}, sequence(0, size(w) - {len(seed)}), cast(array() as array<int>))"
        if known:
            places = f"filter({places}, i -> " + " and ".join(f"f[i + {j}]" for j in ones) + ")"
        parts.append(f"transform({places}, i -> named_struct('h', xxhash64({k if k < len(SEEDS) else -len(seed)}, {words}), 'i', i))")
    return F.expr(f"concat({', '.join(parts)})")


def _overlap() -> Column:
    """SQL over `w`, `b` (item words) and `d` (diagonal): the best stretch (n matching, first and last item word)."""
    zero = "0L as s, 0L as n, 0 as a, 0L as top, 0L as m, 0 as x, -1 as y"
    start = "named_struct(" + ", ".join(f"'{p.split(' as ')[1]}', {p.split(' as ')[0]}" for p in zero.split(", ")) + ")"
    # Running stretch: sum s, matches n, start a; the best so far: sum top, matches m, from x to y.
    step = (
        "(acc, j) -> if(coalesce(get(w, cast(d + j as int)) = b[j], false),"
        " if(acc.s + 1 > acc.top,"
        " named_struct('s', acc.s + 1, 'n', acc.n + 1, 'a', acc.a, 'top', acc.s + 1, 'm', acc.n + 1, 'x', acc.a, 'y', j),"
        " named_struct('s', acc.s + 1, 'n', acc.n + 1, 'a', acc.a, 'top', acc.top, 'm', acc.m, 'x', acc.x, 'y', acc.y)),"
        f" if(acc.s > {MISMATCH},"
        f" named_struct('s', acc.s - {MISMATCH}, 'n', acc.n, 'a', acc.a, 'top', acc.top, 'm', acc.m, 'x', acc.x, 'y', acc.y),"
        " named_struct('s', 0L, 'n', 0L, 'a', j + 1, 'top', acc.top, 'm', acc.m, 'x', acc.x, 'y', acc.y)))"
    )
    return F.expr(f"aggregate(sequence(0, size(b) - 1), {start}, {step}, acc -> named_struct('n', acc.m, 'x', acc.x, 'y', acc.y))")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_match, item_words, first_word, last_word: one row per verified diagonal."""
    bench = materialise(items.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("b")).filter(F.size("b") > 0), "items")
    span = min(map(len, SEEDS))
    short = sorted(r[0] for r in bench.select(F.size("b").alias("n")).filter((F.col("n") >= SHORT) & (F.col("n") < span)).distinct().collect())
    hashed = materialise(bench.withColumnRenamed("b", "w").select("item_id", F.explode(_seed_hashes(False, short, True)).alias("e")).select("item_id", F.col("e.h").alias("h"), F.col("e.i").alias("j")), "item_hashes")
    vocabulary = bench.select(F.explode("b").alias("w")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    n_words = vocabulary.count()
    keyed = rows.withColumn("w", words_of(F.col("t"))).drop("t")
    known = n_words <= MAX_VOCABULARY
    if known:
        names = [r["w"] for r in vocabulary.collect()]
        keyed = keyed.withColumn("f", F.transform("w", lambda x: x.isin(names) if names else F.lit(False)))
    keyed = keyed.select("doc_id", F.explode(_seed_hashes(known, short, False)).alias("e")).select("doc_id", F.col("e.h").alias("h"), F.col("e.i").alias("i"))
    small = hashed.count() <= MAX_BROADCAST
    hits = keyed.join(F.broadcast(hashed) if small else hashed, "h").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("d")).distinct()
    hits = materialise(hits, "hits")
    # Second read of the documents that were hit; their words are compared with the items'.
    ids = hits.select(F.col("doc_id").alias("k")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    hit_rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("k")), "left_semi").withColumn("w", words_of(F.col("t"))).drop("t")
    pairs = hits.join(bench, "item_id").withColumnRenamed("doc_id", "k")
    verified = hit_rows.join(pairs, F.col("doc_id").eqNullSafe(F.col("k"))).select("doc_id", "item_id", "d", F.size("b").alias("size"), _overlap().alias("o"))
    enough = F.col("o.n") >= F.least(F.lit(MIN_WORDS), F.ceil(F.col("size") * MIN_SHARE))
    return verified.filter(enough).select("doc_id", "item_id", F.col("o.n").cast("long").alias("n_match"), F.col("size").cast("long").alias("item_words"), (F.col("d") + F.col("o.x")).cast("long").alias("first_word"), (F.col("d") + F.col("o.y")).cast("long").alias("last_word")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_ids (sorted list), n_items, max_share, first_word, last_word for each contaminated document."""
    found = overlaps(docs, items, id_col, text_col)
    return found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.countDistinct("item_id").alias("n_items"),
        F.max(F.col("n_match") / F.col("item_words")).alias("max_share"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text overlaps no item, with all their columns.

    Rows are named by a hash of id and text, so rows that share an id, or have
    none, are judged each by its own text.
    """
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    found = overlaps(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")), items)
    return drop_rows(docs, found.select("doc_id"), [row])
