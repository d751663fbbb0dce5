"""Vocabulary files and pre-splitting shared by the three tokenizer operators.

Both files describe byte-pair encoders whose merges never cross a pre-split
word, so a word's encoding depends on the word alone.  The operators therefore
work on words and keep what they found in a bounded per-process table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import regex

#: The pre-split patterns and white space class that the two vocabulary files prescribe.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same patterns for texts of ASCII only, which the standard library splits about twice as fast.
ASCII_SPACE = r" \t\n\r\x0b\x0c"
WORD_END_ASCII = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^{ASCII_SPACE}a-z0-9]+"
BYTE_LEVEL_ASCII = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{ASCII_SPACE}A-Za-z0-9]+|[{ASCII_SPACE}]+(?![^{ASCII_SPACE}])|[{ASCII_SPACE}]+"

#: Words in one generation of what a process remembers, and letters of the longest; both bound memory, never the result.
CACHE_WORDS, LONGEST = 300_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in byte order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


class Vocabulary:
    """A vocabulary file: ids, ranked merges, special strings, and its pre-split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.merges: list[tuple[str, str]] = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.folds = spec.get("normalizer") is not None
        self.letters = byte_letters()
        self.byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.agreed: set[str] = set(map(chr, range(128)))
        self.disputed: set[str] = set()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.any_words = regex.compile(WORD_END_PATTERN if self.word_end else BYTE_LEVEL_PATTERN).findall
        self.ascii_words = re.compile(WORD_END_ASCII if self.word_end else BYTE_LEVEL_ASCII).findall

    @cached_property
    def library(self):
        """The tokenizers library's own reading of the file."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def library_words(self, text: str) -> list[str]:
        """The pre-split words of a text by the library's normaliser and pre-split."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _agrees(self, c: str) -> bool:
        """Whether this module folds and splits a letter as the library does, alone and among others."""
        return all(self.words(self.fold(t)) == self.library_words(t) for t in (c, f"a{c}", f"{c}b", f"1{c}2", f" {c} ", f".{c}!", c + c, f"A{c}\u0301", f"e\u0301{c}"))

    def split(self, text: str) -> list[str]:
        """The pre-split words of a text without special strings.

        Python's Unicode tables and the library's are of different versions.
        Each letter is tried once; texts with one that they disagree about are
        split by the library itself.
        """
        if not text.isascii():
            found = set(text)
            if not found <= self.agreed:
                for c in found - self.agreed - self.disputed:
                    (self.agreed if self._agrees(c) else self.disputed).add(c)
                if found & self.disputed:
                    return self.library_words(text)
        return self.words(self.fold(text))

    def words(self, text: str) -> list[str]:
        """The pre-split words of a folded text."""
        return self.ascii_words(text) if text.isascii() else self.any_words(text)

    def fold(self, text: str) -> str:
        """Unicode composition and lower case where the file asks for it."""
        if not self.folds:
            return text
        if not text.isascii():
            # Letter by letter as the library does: a capital sigma is never taken for a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(is special, words) for each stretch of `text`, in order."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield False, self.split(text)
            return
        for k, part in enumerate(self.split_special(text)):
            if k % 2:
                yield True, [part]
            elif part:
                yield False, self.split(part)

    def symbols(self, word: str) -> list[str]:
        """The letters of a word's bytes; the last carries the word end if there is one."""
        letters = self.letters
        out = [letters[b] for b in word.encode("utf-8")]
        if out and self.word_end:
            out[-1] += self.word_end
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The parsed file, once per process."""
    return Vocabulary(path)


_resident: dict = {}


def resident(key: object, make: Callable[[], object]):
    """What `make` gives, kept while this process works for one operator; another operator's takes its place.

    Python workers outlive a stage, so what each stage remembers would add up.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


class WordTable(dict):
    """What `make` gives for a word.

    Two generations of up to `limit` words of up to `LONGEST` letters: when the
    younger is full it becomes the older, from which words that come again are
    taken back.
    """

    def __init__(self, make: Callable[[str], object], limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > LONGEST:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value
