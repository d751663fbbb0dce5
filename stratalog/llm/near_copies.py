"""Near copies: SimHash candidates over word shingles, verified by Jaccard similarity.

This is the corpus form of the SimHash operator: shingles are `WIDTH` words
and two texts are near copies if their sets of shingles have a Jaccard
similarity of `SIMILARITY` or more.  At 0.8 some 15 % of a fingerprint's bits
differ, far beyond what exact segment keys can promise at a bearable number of
keys.  So fingerprints are longer here, 256 bits, and meet under `TABLES` keys
of `KEY_BITS` bits each, chosen once for all.  A pair at similarity 0.8 meets
under at least one with a probability of 0.97, at 0.85 of 0.99 (simulated; the
one step that is not exact).  Of pairs that meet, the chain test on the ring of
the first half's segments prunes those whose cumulative differences leave the
proportional budgets, then the full Hamming check of that half at `MAX_BITS`
(99.5 % of pairs at 0.8 pass), and what is left is compared exactly, shingle
set by shingle set.  Texts meet by chance in groups of nodes / 2 ** KEY_BITS,
which suits up to some 10 ** 9 nodes; beyond that take longer and more keys.

Exact copies are one node.  What is close under some key forms trees.  The
first `FIRST` keys are looked at alone, so that under the others only links
between different trees are given: a class of thousands of near copies meets
again under nearly every key, and is one tree by then.  The links, which span
the trees, are verified pair by pair and joined into components.  A tree of
three or more nodes that still holds several components then has its shingle
sets brought together, in pairs of blocks of `BLOCK_NODES` nodes, and compared
there at once by a matrix product, of which at most one link to a node comes
out.  So a class of thousands of near copies is never expanded into pairs, and
no pair that meets goes untried.

Defined results: null texts and texts without words are near copies of each
other; texts of fewer than `WIDTH` words are one shingle; texts that differ in
white space or in A-Z case only have similarity 1; texts of any length are
taken whole; rows that repeat an id are judged each by its own text; an empty
table gives no rows; columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash import _with_least, components, viable_boxes, whole_groups
from .storage import BROADCAST_IDS, drop_rows, fresh, materialise, python_ready
from .vocab import resident

WIDTH, SIMILARITY = 5, 0.8
WORDS64 = 4
KEY_BITS, TABLES = 18, 96
#: Keys that are looked at first, to know the trees before the others are.
FIRST = 8
#: Of the first 128 bits: how many may differ, and the segments of the chain test.
MAX_BITS, SEGMENTS = 30, 8
#: Nodes of a group up to which all its pairs are looked at at once.
ALL_PAIRS = 24
#: Trees that a task keeps in mind, so as not to link them again.
TREES = 200_000
#: Nodes that lead from one part of a large group to the next.
PIVOTS = 100
HOT_ROWS = 50_000
#: Nodes of a block, and shingles that one step of the matrix product covers; both bound memory.
BLOCK_NODES, STEP = 500, 2048
SEED = 42
#: Hashes whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 15
PRINT = [f"f{k}" for k in range(WORDS64)]
#: The white space that parts words, and the letters that are folded.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 more bits of a hash (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: str | None, width: int = WIDTH) -> tuple[int, ...]:
    """(distinct shingles, the fingerprint as four signed numbers) of a text."""
    words = text.encode("utf-8").lower().split() if text else []
    n = len(words)
    if not n:
        return (0,) * (1 + WORDS64)
    joined = b" ".join(words)
    digest = xxhash.xxh3_128_digest
    if n <= width:
        raw = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.r_[0, ends[:-width]]
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())])
    found = np.frombuffer(raw, "<u8").reshape(-1, 2)
    found = found[np.unique(found[:, 0], return_index=True)[1]]
    total = len(found)
    counts = np.zeros(64 * WORDS64, dtype=np.int64)
    for at in range(0, total, BLOCK):
        part = found[at : at + BLOCK]
        rows = np.concatenate([part, _mixed(part)], axis=1).view(np.uint8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total, *np.packbits(2 * counts > total, bitorder="little").view("<i8").tolist()


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, node (a hash of the text), n and f0 to f3 of each row."""
    names = ["n", *PRINT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("near copies", lambda: None)
        for b in batches:
            found = [sketch(t.as_py(), width) for t in b.column(2)]
            parts = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], ["doc_id", "node", *names])

    python_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, " + ", ".join(f"{c} long" for c in names))


def key_masks(tables: int = TABLES) -> list[tuple[int, ...]]:
    """For each key the bits it looks at, as signed numbers; fixed by the generator's seed."""
    r = np.random.default_rng(5)
    masks = [sum(1 << int(b) for b in r.permutation(64 * WORDS64)[:KEY_BITS]) for _ in range(tables)]
    return [tuple((x := m >> 64 * k & ((1 << 64) - 1)) - (x >> 63 << 64) for k in range(WORDS64)) for m in masks]


def _keyed(nodes: DataFrame, start: int, end: int) -> DataFrame:
    """key, node, tree, f0, f1: each node under each of some of its keys, dealt and sorted by key."""
    masks = F.arrays_zip(*[F.array(*[F.lit(m[k]) for m in key_masks()[start:end]]).alias(f"m{k}") for k in range(WORDS64)])
    keys = F.transform(masks, lambda m, i: F.xxhash64(*[F.col(f).bitwiseAND(m[f"m{k}"]) for k, f in enumerate(PRINT)], i + start))
    return nodes.select(F.explode(keys).alias("key"), "node", "tree", "f0", "f1").repartition("key").sortWithinPartitions("key", "node")


def _close(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the nodes at i and j can be near copies: chain test, then the Hamming check."""
    width = 2 * 64 // SEGMENTS
    boxes = []
    for half in (3, 4):
        diff = x[half][i] ^ x[half][j]
        boxes += [np.bitwise_count((diff >> (k * width)) & ((1 << width) - 1)).astype(np.int16) for k in range(SEGMENTS // 2)]
    ok = viable_boxes(boxes, MAX_BITS)
    ok[ok] = sum(b[ok] for b in boxes) <= MAX_BITS
    return ok


def _forest(x: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, the node that found it) along a spanning forest of the close pairs among the rows `at`.

    Rows are in the order of their nodes and the least one looks first, so the
    same few nodes lead a class under most keys and the links repeat.
    """
    left, members, parents = at, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop(0)
            near = _close(x, np.full(len(left), k), left)
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                members.append(found)
                parents.append(np.full(len(found), k))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *parents])


class Trees:
    """Which trees a task has linked already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, k: int) -> int:
        while (up := self.up.setdefault(k, k)) != k:
            self.up[k] = k = self.up.setdefault(up, up)
        return k

    def joins(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the links between trees i and j, taken in turn, join two that nothing before has."""
        if len(self.up) > TREES:
            self.up.clear()
        new = i != j
        for k in np.flatnonzero(new).tolist():
            a, b = self.find(int(i[k])), self.find(int(j[k]))
            self.up[max(a, b)] = min(a, b)
            new[k] = a != b
        return new


PAIR_SCHEMA = "a long, b long, close boolean"


def _pairs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of close nodes of different trees within the groups of a stream sorted by key, enough to join the trees.

    A group of more than `limit` rows is looked at in parts, of which not every
    pair meets; its nodes become one tree by links that are not close.
    """
    trees = Trees()

    def told(x: list[np.ndarray], i: np.ndarray, j: np.ndarray, close: bool = True) -> pa.RecordBatch:
        new = trees.joins(x[2][i], x[2][j])
        a, b = x[1][i[new]], x[1][j[new]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), close))], ["a", "b", "close"])

    pivots: list[np.ndarray] | None = None
    for x, part in whole_groups(batches, limit):
        if part:  # one group that goes on in the next part
            same = pivots is not None and pivots[0][0] == x[0][0]
            x = [np.r_[p, c] for p, c in zip(pivots, x)] if same else x
            found = _forest(x, np.arange(len(x[0])))
            yield told(x, *found)
            lead = np.setdiff1d(np.arange(len(x[0])), found[0])
            yield told(x, lead, np.zeros(len(lead), np.int64), False)
            pivots = [c[lead[:PIVOTS]] for c in x]
            continue
        first = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
        size = np.diff(np.r_[first, len(x[0])])
        for n in np.unique(size[(size > 1) & (size <= ALL_PAIRS)]).tolist():
            own = first[size == n][:, None]
            one, two = np.triu_indices(n, 1)
            i, j = (own + one).ravel(), (own + two).ravel()
            ok = (x[2][i] != x[2][j]) & _close(x, i, j)
            yield told(x, i[ok], j[ok])
        for s, n in zip(first[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist()):
            yield told(x, *_forest(x, np.arange(s, s + n)))


def joining_links(nodes: np.ndarray, roots: np.ndarray, sets: pa.ListArray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of different roots that are similar enough: enough to join all components that are linked, at most one to a node."""
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(nodes)), size)
    _, at, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # Shingles of one node only are in no intersection.
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
    owner, number = owner[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    shared = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, STEP):
        a, b = np.searchsorted(number, (k, k + STEP))
        part = np.zeros((len(nodes), STEP), dtype=np.float32)
        part[owner[a:b], number[a:b] - k] = 1
        shared += part @ part.T
    linked = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-6
    one = roots[:, None] == roots[None, :]
    left, found = np.ones(len(nodes), dtype=bool), []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue[0]] = False
        while queue:
            k = queue.pop()
            near = np.flatnonzero(left & (linked[k] | one[k]))
            left[near] = False
            queue.extend(near.tolist())
            found += [(k, j) for j in near.tolist() if not one[k, j]]
    i, j = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return nodes[i], nodes[j]


def _several(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root, m: the nodes of trees of three or more that hold several components, and how many blocks each tree has."""
    named = materialise(trees.join(roots, "node", "left").select(F.col("tree").alias("a"), "node", F.coalesce("root", "node").alias("root")), "named")
    sizes = named.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high AND n > 2")
    sizes = materialise(sizes.select("a", "n", F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("m")), "sizes")
    return materialise(_with_least(named, sizes, named.count()).select(F.col("a").alias("key"), "node", "root", "m"), "several")


def _in_blocks(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) across the components of large trees (key, node, root, m)."""
    dealt = large.withColumn("p", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    dealt = dealt.select("key", "node", "root", "p", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("q"))
    dealt = dealt.select("key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "node", "root").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        a, b = joining_links(t["node"].to_numpy(), t["root"].to_numpy(), t["s"].combine_chunks(), similarity)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.select("key", "p", "q", "node", "root", "s").groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def shingle_set(text: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """(the words of a text, the distinct shingles of a column `w` of words, hashed)."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE), lambda w: w != "")
    own = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(width)]))
    own = F.when(F.size("w") >= width, own).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return words, F.array_distinct(own)


def shingle_sets(df: DataFrame, nodes: DataFrame, needed: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """node, s (its shingles) of the nodes in `needed`; each text is read from one row of those that hold it."""
    wanted = materialise(nodes.join(needed.distinct(), "node", "left_semi").select(F.col("node").alias("k"), F.col("least").alias("i")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("t"))
    rows = rows.join(wanted, (F.col("node") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    words, own = shingle_set(F.col("t"), width)
    return materialise(rows.withColumn("w", words).select("node", own.alias("s")).dropDuplicates(["node"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= (F.size("sa") + F.size("sb") - shared) * similarity - 1e-9).select("a", "b")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node; nodes: node, least id, root), the root naming the component of near copies."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(batches, hot_rows)

    rows = materialise(sketches(df, id_col, text_col, width), "sketches")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.min(f).alias(f) for f in PRINT]), "nodes")
    found = materialise(_keyed(nodes.withColumn("tree", F.col("node")), 0, FIRST).mapInArrow(candidates, PAIR_SCHEMA), "candidates")
    trees = components(found.select("a", "b"))
    known = materialise(nodes.join(trees.withColumnRenamed("root", "tree"), "node", "left").withColumn("tree", F.coalesce("tree", "node")), "known")
    more = materialise(_keyed(known, FIRST, TABLES).mapInArrow(candidates, PAIR_SCHEMA), "candidates")
    trees = components(trees.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))
    pairs = materialise(found.unionByName(more).filter("close").select("a", "b").distinct(), "pairs")
    sets = shingle_sets(df, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), id_col, text_col, width)
    links = materialise(verified(pairs, sets, similarity), "similar")
    roots = components(links)
    large = _several(trees.withColumnRenamed("root", "tree"), roots)
    if not large.isEmpty():
        sets = shingle_sets(df, nodes, large.select("node"), id_col, text_col, width)
        more = materialise(_in_blocks(large, sets, similarity), "joining")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return rows.select("doc_id", "node"), nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """doc_id, component_id for each row: the least id among its near copies, null only where all their ids are."""
    rows, nodes = classes(df, id_col, text_col, **more)
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(names, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row of each component, with all its columns: the one with the least id, then the least hash of the text.

    Rows are named by id and hash of the text, so rows that share an id, or
    have none, fall to their own text's component; a null id stays only where
    all ids are null.  Only names are joined; rows are shuffled only where a
    name is on several rows.
    """
    own_id, own_hash = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    rows, nodes = classes(df, id_col, text_col, **more)
    first = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "node")).alias("first")
    stay = materialise(nodes.groupBy("root").agg(first).select(F.col("first.least").alias("least"), F.col("first.node").alias("stays")), "stay")
    named = materialise(rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")), "named")
    judged = named.join(stay, (named["node"] == stay["stays"]) & named["doc_id"].eqNullSafe(stay["least"]), "left")
    judged = materialise(judged.select("doc_id", "node", "n", F.col("stays").isNotNull().alias("stays")), "judged")
    kept = drop_rows(df, judged.filter("not stays").select("doc_id", "node"), [own_id, own_hash])
    shared = judged.filter("stays AND n > 1")
    if shared.isEmpty():
        return kept
    a, b = fresh("_id", df), fresh("_hash", df)
    shared = materialise(shared.select(F.col("doc_id").alias(a), F.col("node").alias(b)), "shared")
    same = own_id.eqNullSafe(F.col(a)) & (own_hash == F.col(b))
    repeated = kept.join(shared, same, "left_semi").withColumn(a, own_id).withColumn(b, own_hash)
    return kept.join(shared, same, "left_anti").unionByName(repeated.dropDuplicates([a, b]).drop(a, b))
