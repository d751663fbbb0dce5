"""SimHash near-duplicates by pigeonring filtering.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its word shingles.  Two fingerprints are linked when at most `max_bits` bits
differ; the linked fingerprints form components.

Candidates come from the pigeonring principle.  Put the segments of a
fingerprint on a ring.  If at most t bits differ over m segments, some start
exists from which every chain of l consecutive segments has at most l * t / m
differing bits.  For t = 4 and m = 7 the budgets of chains of 1 to 5 segments
are 0, 1, 1, 2, 2, so of a viable chain of five the first segment agrees, one
of the next two does, and one more of the remaining three: three equal
segments of 27 bits together.  `chain_keys` derives these segment sets from
the budgets, fingerprints meet where a set agrees, the chain test prunes what
met by chance, and only then comes the full Hamming check.

Groups of copies share one fingerprint, so links are sought between distinct
fingerprints only.  Where many near copies meet under one key the links are
found as a spanning forest, never as all pairs; a key with more than
`hot_rows` fingerprints is dealt over blocks, each pair of blocks in a task of
its own.  Components are found with alternating stars on tables in the shared
folder; what stars with many members, or fingerprints of many copies, bring to
a join is broadcast, as they can only be few.

`near_copies` is the corpus form: shingles of five words, verified by Jaccard.

Defined results: null and wordless texts have fingerprint zero, linked like
any other; shorter texts are one shingle; texts of any length are taken whole;
repeated rows come out once each; a null id is never a component's name unless
all its ids are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, python_ready
from .vocab import resident

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS = 7
CHAIN = 5
SEED = 42
HOT_ROWS = 100_000
#: Nodes and fingerprints of the most arcs and copies whose rows a join broadcasts instead of shuffling, at most.
STARS = 100_000
#: Hashes whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text as an unsigned integer."""
    words = text.encode("utf-8").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.r_[0, ends[:-width]]
    digest = xxhash.xxh64_intdigest
    total = n - width + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, BLOCK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), (ends[width - 1 :][at : at + BLOCK] - 1).tolist())]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("simhash", lambda: None)
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    python_ready(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_masks(m: int = SEGMENTS) -> list[int]:
    """Bit masks of m segments of nearly equal width."""
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def chain_keys(m: int = SEGMENTS, t: int = MAX_BITS, chain: int = CHAIN) -> list[int]:
    """Masks of the segment sets of which one agrees whenever a viable chain of `chain` segments exists.

    For each start: every way to place differing bits that the budgets allow
    leaves some segments equal; the sets kept are the smallest common part of
    them, `need` segments each, which is what any placement leaves at least.
    """
    masks = segment_masks(m)
    budgets = [(length + 1) * t // m for length in range(chain)]
    dirty = {tuple(x) for x in product((0, 1), repeat=chain) if all(sum(x[: k + 1]) <= budgets[k] for k in range(chain))}
    need = min(chain - sum(x) for x in dirty)
    # The first `need` equal segments of each placement suffice as a key.
    sets = {tuple([k for k in range(chain) if not x[k]][:need]) for x in dirty}
    return sorted({reduce(int.__or__, (masks[(start + k) % m] for k in s)) for start in range(m) for s in sets})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def viable_boxes(boxes: list[np.ndarray], t: int) -> np.ndarray:
    """Whether from some start on the ring every chain keeps its budget of differing bits, given the differing bits of each segment."""
    m = len(boxes)
    out = np.zeros(len(boxes[0]), dtype=bool)
    for start in range(m):
        total, ok = 0, ~out
        for length in range(1, m + 1):
            total = total + boxes[(start + length - 1) % m]
            ok &= total <= length * t // m
        out |= ok
    return out


def viable(a: np.ndarray, b: np.ndarray, m: int = SEGMENTS, t: int = MAX_BITS) -> np.ndarray:
    """The pigeonring test of pairs of fingerprints."""
    diff = a ^ b
    return viable_boxes([np.bitwise_count(diff & np.uint64(mask)).astype(np.int16) for mask in segment_masks(m)], t)


def linked(a: np.ndarray, b: np.ndarray, t: int = MAX_BITS) -> np.ndarray:
    """Chain test, then the Hamming check on what is left."""
    ok = viable(a, b, SEGMENTS, t)
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= t
    return ok


def forest(fps: np.ndarray, t: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group: each member under its component's first.

    Each visited member looks at the unvisited ones only, so a dense group is
    done after few looks.  Every look is the chain test, then the Hamming check.
    """
    left, members, roots = fps.copy(), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            near = linked(left, np.full(len(left), x), t)
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                members.append(found)
                roots.append(np.full(len(found), root))
    if not members:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(members), np.concatenate(roots)


def _keyed(fps: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(mask))), F.lit(k)) for k, mask in enumerate(chain_keys())]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The groups of a stream sorted by its first column, as (columns, False) with many whole groups at a time.

    A group of more than `limit` rows comes as several (columns, True), one
    part of that group each, so memory is bounded.
    """
    held: list[np.ndarray] | None = None
    large = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(pair) for pair in zip(held, cols)]
        held = None
        if large is not None and len(cols[0]):
            end = int(np.searchsorted(cols[0] != large, True))
            if end:
                yield [c[:end] for c in cols], True
            cols = [c[end:] for c in cols]
        if not len(cols[0]):
            continue
        large = None
        cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])
        if cut:
            yield [c[:cut] for c in cols], False
            cols = [c[cut:] for c in cols]
        if len(cols[0]) > limit:
            large = cols[0][0]
            yield cols, True
        else:
            held = cols
    if held is not None:
        yield held, False


LINK_SCHEMA = "a long, b long, key long"


def _link_groups(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b, null) within the groups of a stream sorted by key; rows (fp, null, key) of groups beyond `hot_rows`."""
    for (keys, signed), part in whole_groups(batches, hot_rows):
        fps = signed.view(np.uint64)
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(signed), pa.nulls(len(keys), pa.int64()), pa.array(keys)], ["a", "b", "key"])
            continue
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        two = first[size == 2]
        ok = linked(fps[two], fps[two + 1])
        found = [(fps[two + 1][ok], fps[two][ok])] + [forest(fps[i : i + n]) for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist())]
        a, b = (np.concatenate(side).view(np.int64) for side in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])


def links(fps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, b: links that connect what is linked, for a table of distinct fingerprints `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _link_groups(batches, hot_rows)

    python_ready(fps.sparkSession)
    found = materialise(_keyed(fps).repartition("key").sortWithinPartitions("key").mapInArrow(run, LINK_SCHEMA), "links")
    own = found.filter("key IS NULL").select("a", "b")
    large = found.filter("key IS NOT NULL")
    if large.isEmpty():
        return own.distinct()
    # Blocks of about half of hot_rows; every pair of blocks meets in one group, so no group exceeds hot_rows.
    blocks = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2.2 / hot_rows).cast("int").alias("n"))
    dealt = large.join(F.broadcast(blocks), "key").withColumn("i", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    pairs = dealt.select("key", "a", "i", other.alias("j")).select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), F.col("a").alias("fp"))

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _link_groups(batches, 1 << 40)

    split = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(run_blocks, LINK_SCHEMA)
    return own.unionByName(split.select("a", "b")).distinct()


def _with_least(arcs: DataFrame, least: DataFrame, arcs_count: int) -> DataFrame:
    """`arcs` (a, b) joined with `least` (a, m, n: neighbours of a).

    Nodes of many arcs are split off and broadcast: at most `STARS` of them can
    have that many.
    """
    many = max(500, arcs_count // STARS)
    hot = F.broadcast(least.filter(F.col("n") > many).select("a", "m"))
    rest = arcs.join(hot, "a", "left_anti").join(least.filter(F.col("n") <= many).select("a", "m"), "a")
    return arcs.join(hot, "a").unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of `edges` (a, b): root is the least node reachable.

    Alternating large and small stars.  Each round is written to the shared
    folder; it ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.filter("b > a"), low, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, before[0])
        # A node keeps its least neighbour, and each other smaller neighbour is hung below that one too.
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        now = materialise(small, "stars")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = now.select("b").distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(root.select(F.col("b").alias("node"), F.col("b").alias("root")))
    return out if before[0] else spark.createDataFrame([], "node long, root long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    docs = materialise(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), hot_rows))
    named = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked_fps = named.join(names, "root").select("fp", "component_id")
    classes = materialise(distinct.join(linked_fps, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    # Fingerprints of many copies are few, rows / many at most; theirs are broadcast and the rest shuffled.
    many = max(500, docs.count() // STARS)
    hot = F.broadcast(classes.filter(F.col("n") > many).drop("n"))
    rest = docs.join(hot, "fp", "left_anti").join(classes.filter(F.col("n") <= many).drop("n"), "fp")
    return docs.join(hot, "fp").unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
