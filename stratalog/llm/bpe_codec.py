"""BPE encoding and decoding with a tokenization automaton.

The automaton is built in two steps.

*Gadgets.*  An automaton whose arcs are labelled with tokens accepts exactly
the token sequences that byte-pair encoding gives.  It starts as one state
with a loop for each byte.  The merges are applied in rank order, each by one
gadget: for a merge (a, b) the state behind every a-arc is replaced by a copy
that lacks its b-arc, and an ab-arc leads from where that a-arc began to where
the b-arc ended.  The state behind an arc depends on its label alone, so there
is one state per token, and the gadget of ab makes it as a copy of b's state
*at that rank*.  The full table would have |V| squared arcs, 2.5 billion for
50,000 tokens, so a state is kept as what it was copied from, the rank of the
copy, and the arcs that later gadgets took away.

*Determinisation.*  Over bytes that automaton is not deterministic: several
tokens can be under way.  The subset construction makes it so.  A state of the
deterministic automaton is the set of (token that ended, label node reached
since) pairs that are under way; a byte leads to one next state, and the arc
says which token ends there on the accepted path, of which there is exactly
one for each prefix.  Its transition table is filled in as texts cross it, and
emptied when it has `STATES` states; that bounds memory, never the result.

A pre-split word is encoded by table look-ups, one for each byte, and a walk
back over the tokens that ended.  Decoding emits the arcs' labels, the tokens'
bytes.

Defined results: a null text is the empty text (0 tokens); special strings in
a text become their own id, as the library's default does; texts and words of
any length are taken whole; bytes that are no UTF-8 decode to U+FFFD; one row
comes out per row in, so repeated rows and null ids stay; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import python_ready
from .vocab import Vocabulary, WordTable, resident, vocabulary

#: The rank of a byte: before every merge.
BYTE = -1
NEVER = 1 << 60
#: States of the deterministic automaton, and words, that a process remembers.
STATES, WORDS = 100_000, 250_000


class TokenAutomaton:
    """The deterministic automaton of a byte-level vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        byte_of = {letter: bytes([b]) for b, letter in enumerate(vocab.letters)}
        self.special = vocab.special
        self.labels: dict[int, bytes] = {i: b"".join(map(byte_of.__getitem__, s)) for s, i in vocab.ids.items() if s not in self.special}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        # Per token: the rank of the gadget that made its state, and the arcs it was made of.
        self.birth = {i: BYTE for i, label in self.labels.items() if len(label) == 1}
        self.first: dict[int, int] = {}
        self.second: dict[int, int] = {}
        self.taken: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(vocab.merges):
            self._gadget(rank, vocab.ids[left], vocab.ids[right], vocab.ids[left + right])
        self.size = {i: len(label) for i, label in self.labels.items()}
        # The labels of all tokens with a state, as a table from (node, byte) to node.
        self.step: dict[int, int] = {}
        self.ends_in = [-1]
        for i in self.birth:
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.ends_in)
                    self.ends_in.append(-1)
                node = self.step[key]
            self.ends_in[node] = i
        self.table = WordTable(self._word, WORDS)
        self._start()

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        """Take the b-arc from the state behind a; lead an ab-arc past both."""
        self.taken.setdefault((a, b), rank)
        if ab not in self.birth:
            self.birth[ab], self.first[ab], self.second[ab] = rank, a, b

    def _arc(self, u: int, v: int) -> bool:
        """Whether the state behind token u has a v-arc after all gadgets.

        Undoes gadgets from the last on: whichever of u and v is younger was
        made by a gadget that copied an older state or arc, whose arcs held
        until then.
        """
        birth, taken, until, own_end = self.birth, self.taken, NEVER, False
        while True:
            rank = taken.get((u, v), NEVER)
            if rank < until or own_end and rank == until:
                return False
            bu, bv = birth[u], birth[v]
            if bu == bv == BYTE:
                return True
            if bu > bv:
                u, until, own_end = self.second[u], bu, False
            else:  # a gadget on a pair of equal tokens pairs them up from the left
                v, until, own_end = self.first[v], bv, True

    def _start(self) -> None:
        """An empty transition table: state 0 has nothing behind it (-1) and stands at the root of the labels."""
        self.states: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.number: dict[tuple[tuple[int, int], ...], int] = {self.states[0]: 0}
        #: (state, byte) to (next state, token that ends here), as one number each.
        self.transitions: dict[int, int] = {}

    def _compile(self, state: int, byte: int) -> int:
        """One transition of the subset construction, entered into the table."""
        under_way, ended = [], -1
        for u, node in self.states[state]:
            node = self.step.get(node << 8 | byte)
            if node is None:
                continue
            under_way.append((u, node))
            v = self.ends_in[node]
            if v >= 0 and ended < 0 and (u < 0 or self._arc(u, v)):
                ended = v
        under_way.append((ended, 0))
        key = tuple(under_way)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        found = self.transitions[state << 8 | byte] = to << 20 | ended
        return found

    def word_ids(self, word: bytes) -> list[int]:
        """The labels of the accepted path of a word: a table look-up for each byte, then the walk back."""
        table, state, last = self.transitions, 0, []
        for byte in word:
            found = table.get(state << 8 | byte)
            if found is None:
                if len(self.states) >= STATES:  # what is under way now goes over into the emptied table
                    key = self.states[state]
                    self._start()
                    table, state = self.transitions, self.number.setdefault(key, len(self.states))
                    if state == len(self.states):
                        self.states.append(key)
                found = self._compile(state, byte)
            state = found >> 20
            last.append(found & 0xFFFFF)
        out, end, size = [], len(last) - 1, self.size
        while end >= 0:
            out.append(last[end])
            end -= size[last[end]]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[int, str, bytes]:
        ids = self.word_ids(word.encode("utf-8"))
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.labels.__getitem__, ids))

    def runs(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids as text, emitted labels) for each word, in order."""
        at = self.table.__getitem__
        for special, words in self.vocab.pieces(text):
            if special:
                i = self.special[words[0]]
                yield 1, str(i), self.labels[i]
            else:
                yield from map(at, words)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return [int(i) for _, ids, _ in self.runs(text) for i in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their labels, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def automaton(path: str) -> TokenAutomaton:
    return resident(("automaton", path), lambda: TokenAutomaton(vocabulary(path)))


def encode_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array), decoded (text) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocab_path)
        for b in batches:
            ids = [auto.encode(t.as_py() or "") for t in b.column(1)]
            back = [auto.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    python_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of `encode_documents` without its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocab_path)
        for b in batches:
            counts, ids_digests, text_digests = [], [], []
            for t in b.column(1):
                n, ids, labels = zip(*found) if (found := list(auto.runs(t.as_py() or ""))) else ((), (), ())
                counts.append(sum(n))
                ids_digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                text_digests.append(hashlib.sha256(b"".join(labels).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    python_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
