"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  First pass, each block by
itself:

* in a menu, header, footer, sidebar, notice, advert, form or comment
  container, or mostly link text: bad;
* long enough and with enough stop words: good;
* long without stop words: bad, but undecided inside an article container;
* short: undecided.

Second pass: undecided blocks take the label of the nearest decided
neighbours, inside an article container of those inside it.  Where the two
differ or none is decided, a block inside an article is good; elsewhere
headings follow the block after them and others the nearer neighbour, and what
is left is bad.

Defined results: null and empty pages give the empty text; markup that is
broken is read as browsers do as far as blocks go (unclosed paragraphs end at
the next block, unclosed containers at the end); character references are
decoded after tags are found, so encoded tags are text; repeated rows come out
once each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import python_ready

LONG_CHARS = 70
STOP_DENSITY = 0.15
LINK_DENSITY = 0.4

#: Tags by what they do to blocks.
BLOCK_TAGS = frozenset("address article aside blockquote body canvas caption center col colgroup dd dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul details".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("head template object svg math select datalist button audio video noscript".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role attributes that name a container to leave out.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside rail widget widgets notice notices cookie cookies consent gdpr popup modal overlay alert comment comments commentlist disqus reply replies respond form search login signin signup newsletter subscribe subscription share sharing social related recommended recommendations more pagination pager toolbar copyright legal disclaimer contentinfo complementary".split()
)
#: Of those, the ones that an article element may carry and not be the page's article.
NOT_ARTICLES = frozenset("ad advert advertisement comment comments promo promoted recommended related replies reply sponsored".split())
#: Words that inside an article tell nothing, and words that tell something only as a whole name.
TELL_NOTHING = frozenset("header more legal".split())
WHOLE_NAMES = frozenset("related recommended recommendations".split())
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on with as be by at this are from or an have not but had his they i you we he she which their has were been there if would can all will more when who so no out up what into than them its then some could time only other about over also after new our first any these two may such like her my de la le et les des en un une du que qui dans pour est sur au par pas plus ce se ne avec il son sont mais comme ou aux sa leur ses elle cette nous vous je on y der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde el los del las por con una su para al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos".split()
)

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD_SPLIT = re.compile(r"[_\-:/]+|(?<=[a-z])(?=[A-Z])")
#: First words of names that tell what a container has or is not, rather than what it is.
TELLING = frozenset("has with without no not is hide show".split())
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A block of text and what the rules look at."""

    tag: str
    bad: bool
    article: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""


def _tag_end(page: str, at: int) -> int:
    """The place after the tag that starts before `at`; a '>' inside quotes does not end it."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    quote, pos = "", at
    while True:
        if quote:
            close = page.find(quote, pos)
            if close < 0:
                return end + 1
            pos, quote = close + 1, ""
            continue
        stop = page.find(">", pos)
        if stop < 0:
            return end + 1
        opened = [(i, q) for q in "\"'" if (i := page.find(q, pos, stop)) >= 0 and page[max(at, i - 16) : i].rstrip()[-1:] == "="] if '"' in page[pos:stop] or "'" in page[pos:stop] else []
        if not opened:
            return stop + 1
        i, quote = min(opened)
        pos = i + 1


def _is_bad(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether a container is to be left out by its tag or one of its names; an article may have a header of its own."""
    if tag in ("html", "body"):
        return False
    if tag in BAD_TAGS and not (tag == "header" and in_article):
        return True
    known = NOT_ARTICLES if tag in GOOD_TAGS else BAD_NAMES
    for m in NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORD_SPLIT.split(name)]
            if in_article or tag in GOOD_TAGS:
                words = [w for w in words if not (in_article and w in TELL_NOTHING or w in WHOLE_NAMES and len(words) > 1)]
            if words and words[0] not in TELLING and any(w in known for w in words):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, bad, article, hidden
    opened: Counter[str] = Counter()  # tags on the stack
    links = 0
    now = Block("", False, False)

    def state() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def add(raw: str) -> None:
        if not raw or state()[2]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        now.parts.append(text)
        if links:
            now.link_chars += len("".join(text.split()))

    def cut(tag: str) -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                found.append(now)
        bad, article, _ = state()
        now = Block(tag, bad, article and not bad)

    def push(*entry: str | bool) -> None:
        stack.append(entry)
        opened[entry[0]] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", m.end())
                at = n if end < 0 else end + 1
            continue
        tag, closing = name.lower(), bool(m[1])
        at = _tag_end(page, m.end())
        if tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif closing:
            stands = opened[tag] > 0
            if tag in BLOCK_TAGS or stands:
                while stands and pop() != tag:
                    pass
                if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
                    links = 0 if tag in BLOCK_TAGS else links
                    cut(stack[-1][0] if stack else "")
        elif tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = n if close is None else _tag_end(page, close.end())
        elif tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                cut(tag)
        else:
            bad, article, hidden = state()
            attrs = page[m.end() : at]
            if tag in BLOCK_TAGS:
                if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or tag in HEADINGS:
                    while stack and stack[-1][0] in ("p", tag) and stack[-1][0] != "li":
                        pop()
                    bad, article, hidden = state()
                links = 0
                good = tag in GOOD_TAGS or "articleBody" in attrs or 'role="main"' in attrs
                push(tag, bad or _is_bad(tag, attrs, article), article or good, hidden)
                cut(tag)
            elif tag in HIDDEN_TAGS:
                push(tag, bad, article, True)
                cut(tag)
            elif ("class" in attrs or "id" in attrs or "role" in attrs) and _is_bad(tag, attrs, article):
                push(tag, True, article, hidden)
                cut(tag)
    cut("")
    return found


def classify(page_blocks: list[Block]) -> list[Block]:
    """Both passes; each block's label is good or bad afterwards."""
    for b in page_blocks:
        size = len(b.text)
        dense = len("".join(b.text.split()))
        words = LETTERS.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.bad or b.link_chars > LINK_DENSITY * dense:
            b.label = "bad"
        elif size < LONG_CHARS:
            b.label = ""
        elif stop >= STOP_DENSITY:
            b.label = "good"
        else:
            b.label = "" if b.article else "bad"
    n = len(page_blocks)
    before: list[tuple[int, str]] = [(n, "")] * n
    after: list[tuple[int, str]] = [(n, "")] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: int | None = None
        inside: int | None = None
        for k in order:
            b = page_blocks[k]
            seen = inside if b.article else last
            out[k] = (abs(k - seen), page_blocks[seen].label) if seen is not None else (n, "")
            if b.label:
                last = k
                if b.article:
                    inside = k
    for k, b in enumerate(page_blocks):
        if b.label:
            continue
        (far, left), (away, right) = before[k], after[k]
        if left == right:
            label = left or ("good" if b.article else "bad")
        elif b.article:
            label = "good"
        elif not left or not right or b.tag in HEADINGS:
            label = right or left
        else:
            label = left if far < away else right if away < far else "bad"
        # Noted apart, so that a label taken over is not taken over again.
        b.tag += f"|{label}"
    for b in page_blocks:
        if not b.label:
            b.tag, _, b.label = b.tag.rpartition("|")
    return page_blocks


def main_text(page: str | None) -> str:
    """The good blocks of a page, one to a line."""
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; a narrow map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    python_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
