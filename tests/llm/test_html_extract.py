import time

import pytest

from stratalog.llm.html_extract import extract, main_text

LONG = "This is a paragraph of the article that is long enough for the rules and it has many of the stop words in it."
SHELL = '<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>{}</body></html>'


def page(body):
    return SHELL.format(body)


CASES = {
    "plain": (f"<article><h1>Head line</h1><p>{LONG}</p><p>Short.</p></article>", f"Head line\n{LONG}\nShort."),
    "boilerplate": (
        f"<header><h1>Site</h1></header><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- <p>{LONG}</p> --><div class='ad'>{LONG}</div>"
        f"<article><h1>Head</h1><p>{LONG}</p></article><aside>{LONG}</aside><div id='cookie-notice'>{LONG}</div>"
        f"<section class='comments'><p>{LONG}</p></section><form><p>{LONG}</p><input value='x>y'></form><footer>&copy; x. {LONG}</footer>",
        f"Head\n{LONG}",
    ),
    "references": (f"<article><p>Fish &amp; chips &lt;b&gt; caf&eacute; &#8364;&#x41; {LONG}</p></article>", f"Fish & chips <b> café €A {LONG}"),
    "white space": (f"<article><p>a\n\t b&nbsp;c<br>d   <b>e</b>f {LONG}</p></article>", f"a b c d ef {LONG}"),
    "unclosed": (f"<article><h1>H</h1><p><b>{LONG}<br><p>{LONG}</p><p>end", f"H\n{LONG}\n{LONG}\nend"),
    "short article": ("<nav><a href='/'>Home</a></nav><article><h1>A</h1><p>One line.</p></article><footer>f</footer>", "A\nOne line."),
    "links inside": (f"<article><p>{LONG}</p><ul><li><a href='/1'>Related one</a></li></ul><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    "no article": (f"<div><h2>Title here</h2><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div><div><a href='/x'>more</a></div>", f"Title here\n{LONG}\nBrief.\n{LONG}"),
    "long block without stop words": ("<div><p>" + "zzkw qqpt " * 20 + "</p></div>", ""),
    "same in article": ("<article><p>" + "zzkw qqpt " * 20 + "</p></article>", ("zzkw qqpt " * 20).strip()),
    "scripts": (f"<article><p>{LONG}</p><script>if (a < b && '</article>') x()</script><style>a{{}}</style><p>Tail of it.</p></article>", f"{LONG}\nTail of it."),
    "angle brackets": (f"<article><p>1 < 2 and 3 > 2 <3 {LONG}</p></article>", f"1 < 2 and 3 > 2 <3 {LONG}"),
    "attributes": (f"<article><p title='a > b' data-x=\"</p>\">{LONG}</p></article>", LONG),
    "article header": (f"<article><header><h1>Inside</h1></header><p>{LONG}</p></article>", f"Inside\n{LONG}"),
    "telling names": (f"<div class='layout has-sidebar'><article class='post no-comments'><div class='post-header'><h1>Top</h1></div><p>{LONG}</p></article><div class='sideBar widget_1'><p>{LONG}</p></div></div>", f"Top\n{LONG}"),
    "comment articles": (f"<main><p>{LONG}</p></main><section id='comments'><article class='comment'><p>{LONG}</p></article></section>", LONG),
    "comment without container": (f"<main class='sidebar-left'><p>{LONG}</p></main><article class='comment'><p>{LONG}</p></article>", LONG),
    "nested advert": (f"<article><p>{LONG}</p><div class='promo box'><p>{LONG}</p></div><p>Last.</p></article>", f"{LONG}\nLast."),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    body, want = CASES[name]
    assert main_text(page(body)) == want


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<") == ""
    for broken in ("<p", "<!--", "<p title='", "</", "<script>", "&amp", "<article><p>" + LONG, "<a <b <c>" * 200):
        main_text(broken)
    assert main_text("<article><p>" + LONG + "<a href='x") == LONG


def test_rows(spark):
    rows = [(1, "u", page(CASES["plain"][0]), "x"), (1, "u", page(CASES["plain"][0]), "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"), "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(k, u, t := main_text(h), len(t)) for k, u, h, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_keep_their_articles(spark, sf_dir):
    """Against a plain reading of these pages: the text between the article tags."""
    import html
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        want = "\n".join(t for x in parts if (t := " ".join(x.split())))
        assert main_text(r.html) == want


def test_names_inside_articles():
    assert main_text(page(f'<article class="post related-topic"><p>{LONG}</p><div class="more"><p>{LONG}</p></div><p class="legal">{LONG}</p></article>')) == "\n".join([LONG] * 3)
    assert main_text(page(f'<article><p>{LONG}</p><div class="related"><p>{LONG}</p></div></article>')) == LONG


def test_nested_pages_take_linear_time():
    start = time.perf_counter()
    assert main_text("<div>x</b>" * 40_000) == ""
    assert time.perf_counter() - start < 4


def test_tags_with_many_quotes():
    attrs = " ".join(f'd{k}="a > {k}"' for k in range(200))
    assert main_text(f"<article><p {attrs}>{LONG}</p></article>") == LONG
