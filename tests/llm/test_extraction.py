"""Extraction: inline marks, attributes, names in other words, deep pages, pages without names, and a plain second extractor."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from palisade.llm import html


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>one <b class="ad">two</b> three four</p></article>', "one two three four"),
        ('<p>Read our <a class="sponsor">partner</a> and then the rest of this long paragraph.</p>', "Read our partner and then the rest of this long paragraph."),
        ('<div><p>pre<span class="content">fix</span>ed word</p></div>', "prefixed word"),
        ("<article><div data-hidden><p>Text here.</p></div><p x-hidden>And here.</p><p hidden>not here</p><p hidden=hidden>nor here</p></article>", "Text here. And here."),
        ('<article><h2 class="search-engines">Words about them</h2><section class="related-work"><p>Text here.</p></section></article>', "Words about them Text here."),
        ('<div class="notice-of-meeting"><p>' + "A sentence stands here. " * 20 + "</p></div>", ("A sentence stands here. " * 20).strip()),
        ('<div><span class="ad">Buy now</span></div><article><p>One two three.</p></article>', "One two three."),
        ('<a class="promo"><div>Buy now</div></a><article><p>One two three.</p></article>', "One two three."),
        ('<div class="cookie-policy-box"><p>We use them.</p></div><article><p>One two three.</p></article>', "One two three."),
    ],
)
def test_marks_inside_text(page, text):
    assert html.main_text(page, {}) == text


@pytest.mark.parametrize("make", [lambda n: "<div>a" * n, lambda n: "<p>a</p>" + "</section>" * n + "<b>" * n + "x", lambda n: "<b>" * n + "<div>t</div>" * n, lambda n: "<ul><li>" * n, lambda n: "<div>" * n + "<p>x" * n], ids=["deep text", "stray ends", "deep inline", "lists", "deep then flat"])
def test_time_is_linear_in_depth(make):
    def seconds(n):
        began = time.process_time()
        html.main_text(make(n), {})
        return time.process_time() - began

    assert seconds(50_000) <= 2 * min(seconds(25_000) for _ in range(2)) + 2


class Plain(HTMLParser):
    """The generated pages' own structure: what is outside articles and what they mark inside is no text."""

    OUT = {"nav", "footer", "aside", "script", "style", "title", "form", "header"}
    BLOCK = {"p", "h1", "h2", "li", "div", "article", "td", "section", "ul", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("p", "b", "meta", "img", "input"):
            marked = dict(attrs).get("class") or dict(attrs).get("id") or ""
            self.stack.append((tag, tag in self.OUT or bool({"ad", "ads", "comments", "sidebar", "cookie", "notice", "related", "share"} & set(marked.split()))))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.blocks.append("")
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(out for _, out in self.stack):
            self.blocks[-1] += data


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return " ".join(" ".join(b.split()) for b in parser.blocks if b.strip())


def test_all_pages_against_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert [k for k in want if got[k] != want[k]] == []


def stripped(page, tags):
    """A page without names and roles, and without telling tags if asked."""
    page = re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(?:article|main|nav|footer|aside|header|section|form)\b", r"<\1div", page) if tags else page


@pytest.mark.parametrize("tags", [False, True])
def test_pages_without_marks(spark, tags):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    evidence = html.learn_evidence(pages)
    right = found = wanted = 0
    for r in pages.collect():
        got, want = Counter(html.main_text(stripped(r.html, tags), evidence).split()), Counter(html.main_text(r.html, evidence).split())
        right, found, wanted = right + (got & want).total(), found + got.total(), wanted + want.total()
    assert right >= 0.95 * found and right >= 0.95 * wanted
