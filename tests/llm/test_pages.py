"""Pages whose scripts or class names could hide their text."""

import pytest
from palisade.llm import html


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(var i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT type=a>if(a<b && c=='x')</Script >",
        "<style>a<b{}</style>",
        "<script>x='<!--';y='</scripts>'</script>",
        "<title>a <b & c</title>",
        "<textarea><p>x<y</textarea>",
        "<noscript><img alt='<p>'></noscript>",
        "<iframe>i<n</iframe>",
        "<svg><style>a<b{}</style><text>t</text></svg>",
    ],
)
def test_raw_text_ends_at_its_own_tag(raw):
    assert html.main_text(f"<body>{raw}<p>Hello</p><p>there <b>you</b></p></body>", {}) == "Hello there you"


def test_raw_text_without_an_end():
    assert html.main_text("<p>Hello</p><script>i<n", {}) == "Hello"


@pytest.mark.parametrize(
    "page",
    [
        '<html class="has-cookie-banner"><body class="page has-sidebar"><p>One two three.</p><p>Four five.</p></body></html>',
        '<body><main class="with-sidebar"><p>One two three.</p><p>Four five.</p></main></body>',
        '<article class="post sponsored social"><p>One two three.</p><p>Four five.</p></article>',
        '<div class="layout has-sidebar"><article class="post social"><p>One two three.</p><p>Four five.</p></article></div>',
        '<div class="has-sidebar"><div role="main"><p>One two three.</p><p>Four five.</p></div></div>',
    ],
)
def test_names_do_not_drop_the_page(page):
    assert html.main_text(page, {}) == "One two three. Four five."


def test_names_still_mark_boilerplate():
    page = '<body class="has-sidebar"><article><p>One two three.</p><div class="share">Post it</div></article><nav>Menu</nav><div id="comments"><article class="comment-body"><p>Nice!</p></article></div><div class="sidebar"><p>Side</p></div></body>'
    extra = page.replace('id="comments">', 'id="comments"><div class="comment">').replace("</article></div><div", "</article></div></div><div")
    assert html.main_text(extra, {}) == "One two three."


def test_evidence_outweighs_names_only():
    page = '<div class="widget"><p>One two three.</p><p>Four five.</p></div>'
    assert html.main_text(page, {}) == ""
    assert html.main_text(page, {"tag:p": 2.0, "end:True": 2.0}) == ""
    near = "<article><p>One two three.</p><div class=teaser><p>Four five.</p></div><p>Six.</p></article>"
    assert html.main_text(near, {"tag:p": 2.4, "end:True": 2.4, "links:0": 2.4}) == "One two three. Four five. Six." and html.main_text(near, {}) == "One two three. Six."
