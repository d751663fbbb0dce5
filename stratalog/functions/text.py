"""Text functions that filters and pipes compile to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word consists of, and its borders in Java's dialect.
WORD_CHAR = r"[\p{L}\p{N}_]"
BEFORE, AFTER = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"
#: Letters and digits of Unicode 14 and 15, which the regular expressions of Java 17 do not know.
NEWER_CHARS = (
    r"\x{870}-\x{887}\x{889}-\x{88E}\x{8B5}\x{8C8}-\x{8C9}\x{C5D}\x{CDD}\x{170D}\x{171F}\x{1B4C}\x{2C2F}\x{2C5F}\x{9FFD}-\x{9FFF}\x{A7C0}-\x{A7C1}\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}\x{A7F2}-\x{A7F4}"
    r"\x{10570}-\x{1057A}\x{1057C}-\x{1058A}\x{1058C}-\x{10592}\x{10594}-\x{10595}\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}\x{10780}-\x{10785}\x{10787}-\x{107B0}\x{107B2}-\x{107BA}\x{10F70}-\x{10F81}"
    r"\x{11071}-\x{11072}\x{11075}\x{1123F}-\x{11240}\x{11740}-\x{11746}\x{11AB0}-\x{11ABF}\x{11F02}\x{11F04}-\x{11F10}\x{11F12}-\x{11F33}\x{11F50}-\x{11F59}\x{12F90}-\x{12FF0}\x{1342F}\x{13441}-\x{13446}\x{16A70}-\x{16ABE}\x{16AC0}-\x{16AC9}"
    r"\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}\x{1B132}\x{1B155}\x{1D2C0}-\x{1D2D3}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}\x{1E030}-\x{1E06D}"
    r"\x{1E290}-\x{1E2AD}\x{1E4D0}-\x{1E4EB}\x{1E4F0}-\x{1E4F9}\x{1E7E0}-\x{1E7E6}\x{1E7E8}-\x{1E7EB}\x{1E7ED}-\x{1E7EE}\x{1E7F0}-\x{1E7FE}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}\x{31350}-\x{323AF}"
)
#: Capitals of Unicode 16, some of whose small letters are older.
LATER_CAPITALS = "".join(map(chr, (0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66))))
#: Placeholders of pattern filters.
PATTERNS = {"N": r"\d+", "UUID": r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "IP4": r"\d{1,3}(?:\.\d{1,3}){3}", "TIME": r"\d\d:\d\d:\d\d(?:[.,]\d+)?", "DATE": r"\d{4}[-/]\d\d[-/]\d\d", "DATETIME": r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?", "W": r"\S+"}


def literal(text: str) -> str:
    """A regular expression for a text as it stands."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def phrase_pattern(text: str, prefix: bool = False) -> str:
    """A whole phrase at word borders; with `prefix`, only its start is at one."""
    before = BEFORE if re.match(r"[\w]", text) else ""
    after = AFTER if not prefix and re.search(r"[\w]$", text) else ""
    return before + literal(text) + after


def has_phrase(text: Column, phrase: str, prefix: bool = False, any_case: bool = False) -> Column:
    return F.rlike(text, F.lit(("(?iu)" if any_case else "") + phrase_pattern(phrase, prefix)))


def has_sequence(text: Column, phrases: list[str]) -> Column:
    """Phrases one after the other.  Each is taken where it first ends after the one before and never again, so a text is read once however often the phrases occur."""
    return F.rlike(text, F.lit(r"(?s)\A" + "".join(f"(?>.*?{phrase_pattern(p)})" for p in phrases)))


def matches_pattern(text: Column, pattern: str, full: bool = False) -> Column:
    """A pattern of literal text and <N>, <UUID>, <IP4>, <TIME>, <DATE>, <DATETIME>, <W>."""
    parts = re.split(r"<(\w+)>", pattern)
    out = "".join(literal(p) if k % 2 == 0 else PATTERNS[p] if p in PATTERNS else literal(f"<{p}>") for k, p in enumerate(parts))
    return F.rlike(text, F.lit(f"^(?:{out})$" if full else out))


def checked_regexp(pattern: str) -> str:
    """A pattern of the linear-time dialect; look-around and back references are turned away."""
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern!r}")
    return pattern


def java_replacement(text: str) -> str:
    """$1 and ${1} stay group references; named ones ${name} too; backslashes are literal."""
    return re.sub(r"\$\{(\d+)\}", r"$\1", text.replace("\\", "\\\\"))


def common_cases(text: str) -> list[str]:
    return sorted({text, text.lower(), text.upper(), text.title()})


def ipv4_number(text: Column) -> Column:
    """The address as a long, null where the text is none."""
    parts = F.split(text, r"\.")
    numbers = [F.get(parts, k).try_cast("int") for k in range(4)]
    value = F.lit(0).cast("long")
    for n in numbers:
        value = value * 256 + n
    ok = F.size(parts) == 4
    for n in numbers:
        ok = ok & n.between(0, 255)
    return F.when(ok, value)


def ipv4_bounds(spec: str, end: str | None = None) -> tuple[int, int]:
    """First and last address of a CIDR, an address, or a pair."""
    import ipaddress

    if end is not None:
        return int(ipaddress.IPv4Address(spec)), int(ipaddress.IPv4Address(end))
    net = ipaddress.IPv4Network(spec, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_ipv6_range(text: Column, spec: str, end: str | None = None) -> Column:
    """Arrow UDF: Spark has no 128-bit integers."""
    import ipaddress

    low, high = (int(ipaddress.IPv6Address(spec)), int(ipaddress.IPv6Address(end))) if end else (lambda n: (int(n.network_address), int(n.broadcast_address)))(ipaddress.IPv6Network(spec, strict=False))

    def inside(value: str) -> bool:
        try:
            return low <= int(ipaddress.IPv6Address(value)) <= high
        except ValueError:
            return False

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        return values.map(inside, na_action=None).astype(bool)

    return check(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits of two or more characters.

    Letters are lowered one by one: a sigma is the same at a word's end, and a dotted I is an i.
    Those of Unicode 16 separate words.
    """
    single = F.translate(text, "Σİ" + LATER_CAPITALS, "σi" + " " * len(LATER_CAPITALS))
    return F.array_distinct(F.filter(F.split(F.lower(single), rf"[^\p{{L}}\p{{N}}{NEWER_CHARS}]+"), lambda t: F.length(t) >= 2))


def extract_parts(pattern: str) -> tuple[str, list[str]]:
    """(regular expression, names in group order) of an extract pattern like `a=<x> b=<_>`."""
    parts = re.split(r"<(\w*|\*)>", pattern)
    names, out = [], ""
    for k, p in enumerate(parts):
        if k % 2 == 0:
            out += literal(p)
        else:
            last = k == len(parts) - 2 and not parts[k + 1]
            body = ".*" if last else ".*?"
            if p in ("", "_", "*"):
                out += body
            else:
                names.append(p)
                out += f"({body})"
    return "(?s)" + out, names


def format_parts(template: str) -> list[tuple[bool, str]]:
    """(is a field, text) parts of a format like `<a>: <b>`."""
    return [(k % 2 == 1, p) for k, p in enumerate(re.split(r"<([^<>]*)>", template)) if p or k % 2]


def template_of(text: Column) -> Column:
    """A message's template: hex ids to HEX, then digits to N."""
    return F.regexp_replace(F.regexp_replace(text, r"\b[0-9a-f]{8,}\b", "HEX"), r"\d+", "N")
