"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of byte symbols.  A heap holds every
adjacent pair that has a merge rank; the lowest rank (leftmost on ties) is
popped, stale entries are skipped, the pair is joined, and the two pairs it
forms with its neighbours are pushed.  A word of n initial symbols that took m
merges has n - m tokens, so no identifier is ever looked up or emitted.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens);
special strings inside a text count one token each, as the library's default
does; texts and words of any length are counted whole; of equal ranks the
leftmost pair is merged first; one row comes out per row in, so repeated rows
and null ids stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import python_ready
from .vocab import Vocabulary, WordTable, resident, vocabulary

#: Documents above this many tokens are flagged.
TOKEN_LIMIT = 2048


class MergeCounter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.rank = {pair: k for k, pair in enumerate(vocab.merges)}
        self.table = WordTable(self.word_tokens)

    def word_tokens(self, word: str) -> int:
        """Initial symbols minus merges."""
        sym: list[str | None] = list(self.vocab.symbols(word))
        n, rank = len(sym), self.rank
        if n < 2:
            return n
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = nxt[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # one of the two was joined to another neighbour meanwhile
            joined = sym[i] = left + right
            sym[j] = None
            merges += 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank.get((joined, sym[k]))) is not None:
                    heappush(heap, (r, i, joined, sym[k]))
            if (h := prv[i]) >= 0 and (r := rank.get((sym[h], joined))) is not None:
                heappush(heap, (r, h, sym[h], joined))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        at = self.table.__getitem__
        return sum(len(words) if special else sum(map(at, words)) for special, words in self.vocab.pieces(text))


def counter(path: str) -> MergeCounter:
    return resident(("count", path), lambda: MergeCounter(vocabulary(path)))


def token_counts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; a narrow map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab_path).count
        for b in batches:
            n = [count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    python_ready(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
