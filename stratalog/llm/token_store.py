"""Token-id shards with a minimal perfect hash index.

Documents are dealt into ranges of ascending key; each range becomes one
shard of two files, written by one task:

* `<shard>.ids`: the raw ids of its documents, one after the other, as
  little-endian unsigned integers of 2 bytes (4 if the vocabulary has more
  than 65,536 ids), each document closed by the end id;
* `<shard>.idx`: a minimal perfect hash index over the document keys.  A key
  is hashed into a bucket; the bucket's seed sends each of its keys to a slot
  of its own among exactly as many slots as there are keys (a lone key's seed
  is its slot).  A slot holds the key's 64-bit fingerprint, the offset and the
  length of its ids.  A lookup reads the header, one seed and one slot by
  their places in the file, whatever the shard's size; the fingerprint turns
  away keys that are not in it.

Repeated keys share one slot; its length is then the place of the adjacent
documents' lengths in a table behind the slots.  After that come the keys in
order, for whoever reads all.  A null key is stored like a key of its own and
sorts first.  The manifest has each shard's first and last key, which leads
from a key to its shards (several only if a key has very many documents).

A task writes under a name of its own and then renames, so a task that is run
again after an executor was lost leaves the same two files.  Ids come from the
tokenizers library word by word (its pre-split makes words independent).

Defined results: a null text is the empty text; texts of any length are stored
whole; documents of one key come in the order of their text's hash, repeated
rows once each; an empty table gives no shard and no rows; other columns are
not read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, new_path, python_ready
from .vocab import WordTable, resident, vocabulary

MAGIC = b"SLTOKID1"
HEADER = struct.Struct("<8sIIQQQ")  # magic, id width, buckets, slots, lengths of repeated keys, null keys (0 or 1)
SLOT = np.dtype([("print", "<u8"), ("start", "<u8"), ("length", "<u8"), ("count", "<u4")])
SPAN = np.dtype([("key", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8")])
#: Keys per bucket of the index, on average.
BUCKET_KEYS = 4
#: Seeds tried at once, and the bit that marks a seed as a slot.
SEED_BLOCK = 128
DIRECT = np.uint32(1 << 31)
#: Words in one generation of what a process remembers of the library's answers.
WORDS = 400_000
#: The id that closes a document.
END_ID = 1


class Encoder:
    """Raw ids of texts; the library is asked once for each word a process remembers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocab = vocabulary(path)
        top = max(max(self.vocab.ids.values()), *self.vocab.special.values(), END_ID)
        self.kind = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.table = WordTable(self._word, WORDS)

    def _word(self, word: str) -> bytes:
        # The library's model, on a word that is folded and split off already.
        letters = self.vocab.letters
        found = [t.id for t in self.library.model.tokenize("".join([letters[b] for b in word.encode()]))]
        return struct.pack(f"<{len(found)}{self.code}", *found)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text without an end id."""
        at = self.table.__getitem__
        return b"".join([np.asarray([self.vocab.special[w[0]]], dtype=self.kind).tobytes() if special else b"".join(map(at, w)) for special, w in self.vocab.pieces(text)])


def encoder(path: str) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(path))


def key_hashes(keys: list[int | None]) -> np.ndarray:
    """64-bit fingerprints of keys."""
    return np.array([xxhash.xxh64_intdigest(b"" if k is None else int(k).to_bytes(8, "little", signed=True), 7) for k in keys], dtype=np.uint64)


def mixed(prints: np.ndarray, seeds: np.ndarray | int) -> np.ndarray:
    """Fingerprints hashed again under seeds (the splitmix64 finaliser); shapes broadcast."""
    with np.errstate(over="ignore"):
        x = prints + np.asarray(seeds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def perfect_hash(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key) for distinct fingerprints: hash, displace, largest bucket first.

    A bucket of one key needs no search: its seed names a free slot outright.
    """
    n = len(prints)
    buckets = max(1, -(-n // BUCKET_KEYS))
    seeds = np.zeros(buckets, dtype=np.uint32)
    slots = np.zeros(n, dtype=np.int64)
    if not n:
        return seeds, slots
    at = (mixed(prints, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(buckets + 1))
    free = np.ones(n, dtype=bool)
    sizes = np.diff(bounds)
    for b in np.argsort(-sizes, kind="stable").tolist():
        if sizes[b] < 2:
            break
        members = order[bounds[b] : bounds[b + 1]]
        own, seed = prints[members], 1
        while True:
            # A block of seeds at a time; the first that puts every key on a free slot of its own wins.
            block = (mixed(own[None, :], np.arange(seed, seed + SEED_BLOCK)[:, None]) % np.uint64(n)).astype(np.int64)
            ok = free[block].all(axis=1)
            ok[ok] = (np.diff(np.sort(block[ok], axis=1), axis=1) > 0).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                seeds[b], slots[members] = seed + k, block[k]
                free[block[k]] = False
                break
            seed += SEED_BLOCK
    single = np.flatnonzero(sizes == 1)
    rest = np.flatnonzero(free)
    slots[order[bounds[single]]] = rest
    seeds[single] = DIRECT | rest.astype(np.uint32)
    return seeds, slots


def slot_of(prints: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each fingerprint under an index of `n` slots."""
    return seeded(prints, seeds[(mixed(prints, 0) % np.uint64(len(seeds))).astype(np.int64)], n)


def seeded(prints: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The slot of each fingerprint under its own bucket's seed."""
    hashed = (mixed(prints, own) % np.uint64(n)).astype(np.int64)
    return np.where(own & DIRECT, (own & ~DIRECT).astype(np.int64), hashed)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path in it; `new_path` gives URIs with a scheme."""
    return fs.FileSystem.from_uri(uri)


def index_bytes(spans: np.ndarray, width: int) -> bytes:
    """The index file of a shard whose documents stand in key order."""
    first = np.flatnonzero(np.r_[True, (spans["key"][1:] != spans["key"][:-1]) | (spans["null"][1:] != spans["null"][:-1])]) if len(spans) else np.zeros(0, np.int64)
    null = spans["null"][first].astype(bool)
    prints = key_hashes([None if none else int(k) for k, none in zip(spans["key"][first], null)])
    seeds, slots = perfect_hash(prints)
    count = np.diff(np.r_[first, len(spans)])
    several = np.repeat(count > 1, count)
    length = np.where(count > 1, np.cumsum(np.where(count > 1, count, 0)) - count, spans["n"][first].astype(np.int64))
    table = np.zeros(len(first), dtype=SLOT)
    for name, values in (("print", prints), ("start", spans["start"][first]), ("length", length), ("count", count)):
        table[name][slots] = values
    out = io.BytesIO()
    out.write(HEADER.pack(MAGIC, width, len(seeds), len(table), int(several.sum()), int(null.any())))
    for part in (seeds.astype("<u4"), table, spans["n"][several].astype("<u8"), spans["key"][first].astype("<i8")):
        out.write(part.tobytes())
    return out.getvalue()


class Shard:
    """One shard, opened for keyed access; only the header is read until a key is asked for."""

    def __init__(self, folder: str, name: str):
        self.fs, self.path = file_system(f"{folder}/{name}")
        self.index, self.payload = (self.fs.open_input_file(f"{self.path}.{kind}") for kind in ("idx", "ids"))
        magic, width, self.buckets, self.n, n_lengths, self.nulls = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is no index of this format")
        self.kind = np.dtype(f"<u{width}")
        self.at_slots = HEADER.size + 4 * self.buckets
        self.at_lengths = self.at_slots + SLOT.itemsize * self.n
        self.at_keys = self.at_lengths + 8 * n_lengths

    def _read(self, at: int, size: int) -> bytes:
        return self.index.read_at(size, at)

    def close(self) -> None:
        self.index.close()
        self.payload.close()

    def keys(self, at: int, n: int) -> list[int | None]:
        """Keys in order, from the at-th on."""
        found: list[int | None] = np.frombuffer(self._read(self.at_keys + 8 * at, 8 * min(n, self.n - at)), "<i8").tolist()
        if self.nulls and at == 0 and found:
            found[0] = None
        return found

    def _spans(self, slot: np.void, own: np.uint64) -> list[tuple[int, int]]:
        """(offset, length) of each document of a slot, none if its fingerprint is another key's."""
        if slot["print"] != own:
            return []
        start, length, count = int(slot["start"]), int(slot["length"]), int(slot["count"])
        if count == 1:
            return [(start, length)]
        lengths = np.frombuffer(self._read(self.at_lengths + 8 * length, 8 * count), "<u8").astype(np.int64)
        return list(zip((start + np.cumsum(lengths) - lengths).tolist(), lengths.tolist()))

    def find(self, key: int | None) -> list[tuple[int, int]]:
        """(offset, length) of a key's documents: one seed, one slot, one comparison."""
        if not self.n:
            return []
        own = key_hashes([key])
        bucket = int(mixed(own, 0)[0] % np.uint64(self.buckets))
        seed = np.frombuffer(self._read(HEADER.size + 4 * bucket, 4), "<u4")
        place = int(seeded(own, seed, self.n)[0])
        slot = np.frombuffer(self._read(self.at_slots + SLOT.itemsize * place, SLOT.itemsize), SLOT)[0]
        return self._spans(slot, own[0])

    def find_all(self, batch: int = 4096) -> Iterator[tuple[int | None, int, int]]:
        """(key, offset, length) of every document in key order, each found by its key through the index."""
        seeds = np.frombuffer(self._read(HEADER.size, 4 * self.buckets), "<u4")
        slots = np.frombuffer(self._read(self.at_slots, SLOT.itemsize * self.n), SLOT)
        for at in range(0, self.n, batch):
            keys = self.keys(at, batch)
            own = key_hashes(keys)
            for key, p, slot in zip(keys, own, slots[slot_of(own, seeds, self.n)]):
                spans = self._spans(slot, p)
                if not spans:
                    raise ValueError(f"{self.path}.idx does not lead to its own key {key}")
                for start, n in spans:
                    yield key, start, n

    def read(self, start: int, n: int) -> np.ndarray:
        """The raw ids at an offset."""
        return np.frombuffer(self.payload.read_at(n * self.kind.itemsize, start * self.kind.itemsize), self.kind)

    def ids(self, key: int | None) -> list[np.ndarray]:
        """The raw ids of each document with this key."""
        return [self.read(start, n) for start, n in self.find(key)]


class Store:
    """All shards of a folder for keyed access, by the rows of the manifest, one per shard."""

    def __init__(self, folder: str, manifest: DataFrame):
        rows = manifest.select("shard", "name", "null_first", "first_key", "last_key").orderBy("shard").collect()
        self.folder, self.rows = folder, rows

    def ids(self, key: int | None) -> list[np.ndarray]:
        """The raw ids of each document with this key; only shards whose range holds it are opened."""
        out = []
        for r in self.rows:
            if r["null_first"] if key is None else r["first_key"] is not None and r["first_key"] <= key <= r["last_key"]:
                shard = Shard(self.folder, r["name"])
                out += shard.ids(key)
                shard.close()
        return out


def write_shards(df: DataFrame, folder: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Write shards in ascending key order; returns shard, name, n_docs, n_tokens, null_first, first_key, last_key, one row each.

    The result is lazy: evaluating it writes the files, so write it out once.
    The range shuffle spreads a heavily repeated key by its text's hash.
    """
    rows = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    python_ready(df.sparkSession)
    ranged = rows.repartitionByRange(shards, "k", "h") if shards else rows.repartitionByRange("k", "h")
    ranged = ranged.sortWithinPartitions("k", "h").select(F.spark_partition_id().alias("p"), "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, spans, at, name, out, part = encoder(vocab_path), [], 0, None, None, None
        width = enc.kind.itemsize
        end = np.asarray([end_id], dtype=enc.kind).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                part = b.column(0)[0].as_py()
                name = f"{part:06d}"
                system, path = file_system(folder)
                system.create_dir(path, recursive=True)
                own = f"{path}/.{name}-{uuid.uuid4().hex}"
                out = system.open_output_stream(f"{own}.ids")
            for k, t in zip(b.column(1).to_pylist(), b.column(2)):
                raw = enc.encode(t.as_py()) + end
                out.write(raw)
                n = len(raw) // width
                spans.append((k or 0, k is None, at, n))
                at += n
        if out is not None:
            out.close()
            with system.open_output_stream(f"{own}.idx") as f:
                f.write(index_bytes(np.array(spans, dtype=SPAN), width))
            for kind in ("ids", "idx"):
                system.move(f"{own}.{kind}", f"{path}/{name}.{kind}")
            keys = [k for k, none, *_ in spans if not none]
            kinds = [("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("null_first", pa.bool_()), ("first_key", pa.int64()), ("last_key", pa.int64())]
            row = [part, name, len(spans), at, bool(spans[0][1]), keys[0] if keys else None, keys[-1] if keys else None]
            yield pa.RecordBatch.from_pylist([dict(zip([c for c, _ in kinds], row))], schema=pa.schema(kinds))

    return ranged.mapInArrow(run, "shard int, name string, n_docs long, n_tokens long, null_first boolean, first_key long, last_key long")


def read_shards(manifest: DataFrame, folder: str, batch_docs: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every stored document, each found by its key through its shard's index.

    `manifest` has shard, name and base, the ids in all shards before.  The crc
    is of the ids as little-endian unsigned 32-bit integers.  One task holds
    one shard's index and one document's ids at a time.
    """
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, name, base in zip(*(c.to_pylist() for c in b.columns)):
                shard, rows = Shard(folder, name), []
                for key, start, n in shard.find_all():
                    rows.append((key, base + start, n, zlib.crc32(shard.read(start, n).astype("<u4").tobytes()), part))
                    if len(rows) >= batch_docs:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [c for c, _ in kinds])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [c for c, _ in kinds])
                shard.close()

    return manifest.select("shard", "name", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def stored_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32, shard.

    `start` counts the ids of all documents before: a running sum over the
    manifest's rows, one per shard, plus the place in the shard.
    """
    folder = new_path(df.sparkSession, "ids")
    manifest = materialise(write_shards(df, folder, vocab_path, id_col, text_col, shards), "manifest")
    # One row per shard: the running sum needs them in one place, and they are as few as the files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # A task for each shard, dealt by turns.
    return read_shards(based.repartition(max(1, manifest.count())), folder)
