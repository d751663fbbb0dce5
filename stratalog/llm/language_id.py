"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text.  A document is parsed against each automaton from left to
right: each phrase is the longest match that occurs in the language's sample.
The fewer phrases, the closer the language.  Phrases are normalised: one that
occurs in a sample of m symbols costs ln(2 m), the place it is copied from and
a flag; a symbol that the sample lacks costs ln(2 A), A being the number of
different symbols of all samples.  So a tiny sample pays for the letters it
lacks.  The cheapest language wins; `score` is its share of the weights
exp(-cost) over all languages.

Text is lower-cased, a run of anything but letters is one space, and symbols
are the UTF-8 bytes of that, which bounds every table by 256 columns whatever
the alphabet.  The automata are completed into transition tables, so many
documents advance in lock step, one table look-up per symbol and language.
Long documents are cut into blocks of `BLOCK` symbols that advance side by
side, each from the start state; then each block is parsed again from the
state its predecessor ended in, until a phrase starts where one started
before, and so on until nothing changes: the counts are those of one parse
from the first symbol to the last.

Defined results: null texts and texts without a letter are `und` with score 0;
texts of any length are parsed whole; ties go to the first language in order;
a language whose sample has no letter is not learned, and without any learned
language every row is `und`; rows that repeat an id or have none come out once
each; an empty table gives no rows; other columns are not read.

Bounds on what is learned from: `DOCS` labelled documents per language, those
of the least hashes, and of each a window of `CHARS` / `DOCS` characters at a
place that goes by the hash.  A language then takes up to 50 MB in a Python
worker, 10 MB where its text has the 50 or so different bytes of a European
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import python_ready
from .vocab import resident

UNDECIDED = "und"
#: Labelled documents sampled per language, and characters learned from in all.
DOCS, CHARS = 48, 24_000
#: Symbols that a lane takes before the next lane begins.
BLOCK = 512
#: Symbols whose lanes advance together; bounds memory.
LANE_SYMBOLS = 8_000_000


_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
#: 1 for letters, 0 for others, -1 for code points not met yet.
_is_letter = np.full(0x110000, -1, dtype=np.int8)


def letters_only(text: str) -> bytes:
    """Lower-cased letters, runs of anything else as one space, none at either end."""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    kind = _is_letter[codes]
    if (kind < 0).any():
        for c in np.unique(codes[kind < 0]).tolist():
            _is_letter[c] = chr(c).isalpha()
        kind = _is_letter[codes]
    plain = np.where(kind == 1, codes, 32).astype("<u4").tobytes().decode("utf-32-le")
    return b" ".join(plain.encode().split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def parse_table(symbols: np.ndarray, size: int) -> np.ndarray:
    """The completed automaton: entry [state * size + symbol] is 2 * next state + (1 if a phrase starts)."""
    nxt = suffix_automaton(symbols.tolist())
    start = np.zeros(size, dtype=np.int32)
    for c, q in nxt[0].items():
        start[c] = q
    table = np.tile(2 * start + 1, (len(nxt), 1))
    for s, arcs in enumerate(nxt[1:], 1):
        for c, q in arcs.items():
            table[s, c] = 2 * q
    return table.ravel()


class CrossParser:
    """Automata of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        parts = [(name, letters_only(text)) for name, text in samples]
        parts = [(name, raw) for name, raw in parts if raw]
        self.languages = [name for name, _ in parts]
        used = sorted(set(b"".join(raw for _, raw in parts)))
        self.size = len(used) + 1  # 0 stands for bytes that no sample has
        self.number = np.zeros(256, dtype=np.uint8 if self.size <= 256 else np.uint16)
        self.number[used] = np.arange(1, self.size)
        own = [self.symbols(raw) for _, raw in parts]
        self.tables = [parse_table(p, self.size) for p in own]
        self.phrase_cost = np.array([np.log(2 * len(p)) for p in own])
        self.lacking = np.array([np.bincount(p, minlength=self.size) == 0 for p in own], dtype=np.int64).reshape(-1, self.size)
        self.lack_cost = np.log(2 * self.size)

    def symbols(self, raw: bytes) -> np.ndarray:
        return self.number[np.frombuffer(raw, np.uint8)]

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrase counts [document, language]."""
        out = np.zeros((len(docs), len(self.tables)), dtype=np.int64)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        lanes = -(-lengths // BLOCK)
        n = int(lanes.sum())
        if not n:
            return out
        doc_of = np.repeat(np.arange(len(docs)), lanes)
        place = np.arange(n) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        lane_len = np.minimum(lengths[doc_of] - place * BLOCK, BLOCK)
        grid = np.zeros((n, BLOCK), dtype=self.number.dtype)
        at = 0
        for d, k in zip(docs, lanes.tolist()):
            if k:
                grid[at : at + k].reshape(-1)[: len(d)] = d
                at += k
        # Lanes by falling length, so those that still run are the first ones; a column for each lane.
        order = np.argsort(-lane_len, kind="stable")
        grid = np.ascontiguousarray(grid[order].T)
        doc_of, lane_len, place = doc_of[order], lane_len[order], place[order]
        follower = np.full(n, -1)
        where = np.empty(n, dtype=np.int64)
        where[order] = np.arange(n)
        follower[where[:-1]] = where[1:]
        follower[doc_of[follower] != doc_of] = -1
        active = np.searchsorted(-lane_len, -np.arange(BLOCK), side="left")
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(doc_of, weights=self._lanes(table, grid, active, lane_len, follower), minlength=len(docs)).astype(np.int64)
        return out

    def _lanes(self, table: np.ndarray, grid: np.ndarray, active: np.ndarray, lane_len: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Phrases that start in each lane when every lane goes on where its predecessor ended."""
        n, size = grid.shape[1], self.size
        state = np.zeros(n, dtype=np.int32)
        starts = np.zeros(grid.shape, dtype=bool)
        for t in range(int(lane_len[0])):
            m = int(active[t])
            v = table[state[:m] * size + grid[t, :m]]
            state[:m] = v >> 1
            starts[t, :m] = v & 1
        fresh = starts.sum(axis=0)
        count, end = fresh.copy(), state.copy()
        begun = np.flatnonzero(follower >= 0)  # lanes whose end has not been handed on yet
        while len(begun):
            lane, come = follower[begun], end[begun]
            more = np.zeros(len(lane), dtype=np.int64)  # phrases from the handed state, less those from the start state
            last = state[lane].copy()  # where the lane ends: as from the start state once both parses meet
            run = np.arange(len(lane))
            for t in range(BLOCK):
                over = lane_len[lane[run]] <= t
                last[run[over]] = come[run[over]]
                run = run[~over]
                if not len(run):
                    break
                v = table[come[run] * size + grid[t, lane[run]]]
                come[run] = v >> 1
                begins, began = v & 1, starts[t, lane[run]]
                more[run] += begins - began.astype(np.int64)
                run = run[(begins == 0) | ~began]  # where a phrase begins in both they are one from here on
            last[run] = come[run]
            count[lane] = fresh[lane] + more
            changed = lane[last != end[lane]]
            end[lane] = last
            begun = changed[follower[changed] >= 0]
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        docs = [self.symbols(letters_only(t)) if t else np.zeros(0, np.uint8) for t in texts]
        names, scores = [UNDECIDED] * len(docs), [0.0] * len(docs)
        if not self.languages:
            return names, scores
        at = 0
        while at < len(docs):
            end, total = at, 0
            while end < len(docs) and (end == at or total + len(docs[end]) <= LANE_SYMBOLS):
                total += len(docs[end])
                end += 1
            own = docs[at:end]
            lacking = np.array([np.bincount(d, minlength=self.size) for d in own]) @ self.lacking.T
            # A symbol that the sample lacks is a phrase of its own.
            cost = (self.phrases(own) - lacking) * self.phrase_cost + lacking * self.lack_cost
            best = cost.argmin(axis=1)
            share = 1 / np.exp(np.maximum(cost.min(axis=1, keepdims=True) - cost, -700)).sum(axis=1)
            for k in range(end - at):
                if len(own[k]):
                    names[at + k], scores[at + k] = self.languages[best[k]], float(share[k])
            at = end
        return names, scores


def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return resident(("language", samples), lambda: CrossParser(samples))


def learn(df: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, sample text) for each labelled language.

    The sample's rows are chosen from ids and labels alone (the least hashes of
    each language), so one narrow scan finds them and a second reads a window of
    their text.  A language has as many ids sampled as `DOCS`, and as many rows.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.filter(where) if where is not None else rows
    least = Window.partitionBy("lang").orderBy("h", "k")
    keyed = rows.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h"))
    chosen = [r["k"] for r in keyed.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= DOCS).select("k").distinct().collect()]
    size = CHARS // DOCS
    first = F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.greatest(F.length(text_col) - size + 1, F.lit(1)).cast("long")).cast("int") + 1
    window = F.substring(F.col(text_col), first, F.lit(size))
    texts = rows.filter(F.col(id_col).isin(chosen)).select(F.col(lang_col).cast("string").alias("lang"), window.alias("t"), F.col(id_col).alias("k")).collect() if chosen else []
    found: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], str(r["k"]), r["t"])):
        own = found.setdefault(r["lang"], [])
        if len(own) < DOCS:
            own.append(r["t"])
    return tuple((lang, " ".join(parts)) for lang, parts in sorted(found.items()))


def identify(df: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row; a narrow map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(samples)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                names, scores = p.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    python_ready(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    samples = learn(df, fold(id_col, 5) != 0, id_col, text_col, lang_col)
    return identify(df, samples, id_col, text_col).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
