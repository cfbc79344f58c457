"""Pages on which evidence and ties, not the page's own marks, decide; and whole-page cuts against all labellings."""

import itertools

import pytest
from palisade.llm import html
from test_text import cost_of

P = "Prose of the story runs on here, with commas and more than a dozen words in it. It has two sentences."
PAGES = {
    "no marks at all": (
        f"<div><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>About us</a></div></div><div><div>Short title</div><p>{P}</p><p>Yes.</p><p>{P}</p></div><div><a href=x>Older post</a> <a href=y>Newer post</a></div>",
        f"Short title {P} Yes. {P}",
    ),
    "a menu without a name inside an article": (f"<article><p>{P}</p><ul><li><a href=1>One</a></li><li><a href=2>Two more</a></li><li><a href=3>Three</a></li></ul><p>{P}</p></article>", f"{P} {P}"),
    "a part whose name misleads": (f'<article><p>{P}</p><p class="widget">{P}</p><p>{P}</p></article>', f"{P} {P} {P}"),
    "a linked heading that its neighbours keep": (f"<article><p>{P}</p><h2><a href=q>Title</a></h2><p>{P}</p></article>", f"{P} Title {P}"),
    "short items that look like a menu": (f"<article><p>{P}</p><ul><li>Apples</li><li>Pears</li></ul><p>{P}</p></article>", f"{P} Apples Pears {P}"),
    "an advert of prose": (f'<article><p>{P}</p><div class="ad">{P}</div><p>{P}</p></article>', f"{P} {P}"),
    "a sidebar of prose": (f"<article><p>{P}</p><aside><p>{P}</p></aside><p>{P}</p></article>", f"{P} {P}"),
    "comments of prose": (f'<article><p>{P}</p></article><div id="comments"><p>{P}</p></div>', P),
    "a page that is one form": (f"<form id=all><nav><a>Menu</a></nav><main><p>{P}</p></main></form>", P),
    "a form of prose": (f"<article><p>{P}</p><form><p>{P}</p></form></article>", P),
    "a name that tells of the layout": (f'<div class="layout has-sidebar"><p>{P}</p><p>{P}</p></div>', f"{P} {P}"),
}


@pytest.fixture(scope="module")
def evidence(spark, sf):
    return html.learn_evidence(spark.read.parquet(f"{sf}/pages.parquet"))


def by_zones(page):
    return " ".join(b.text for b in html.blocks(page) if not b.boiler and not b.named)


@pytest.mark.parametrize("case", PAGES)
def test_pages(evidence, case):
    page, want = PAGES[case]
    assert html.main_text(page, evidence) == want


def test_marks_alone_would_be_wrong(evidence):
    assert [k for k, (page, want) in PAGES.items() if by_zones(page) != want] == list(PAGES)[:3]


def test_flows_decide_some_pages(evidence, monkeypatch):
    ran, flow = [], html._max_flow
    monkeypatch.setattr(html, "_max_flow", lambda *a: ran.append(1) or flow(*a))
    html.main_text(PAGES["a menu without a name inside an article"][0], evidence)
    assert ran


@pytest.mark.parametrize("case", PAGES)
def test_whole_page_cuts_are_least(evidence, case):
    found = html.blocks(PAGES[case][0])
    costs, ties = html.terms(found, evidence)
    best = min(cost_of(x, costs, ties) for x in itertools.product([False, True], repeat=len(found)))
    assert abs(cost_of(html.least_cut(costs, ties), costs, ties) - best) < 1e-9


def test_empty_table_and_clashing_columns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(3).selectExpr("*", "'x' as text", "1 as n_chars", "2 as cue")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "cue", "text", "n_chars"] and got.filter("text = 'x'").count() == 0
    assert html.extract(pages.limit(0)).count() == 0
