"""Main-text extraction from web pages: text blocks labelled by a minimum cut.

A page is cut into text blocks. A classifier's costs tie each block to the
content or the boilerplate terminal: what its place in the page's structure
says (one group of features) and evidence learned from all pages (tag, length,
links, punctuation, position). Neighbours in page order are tied to each other
the more, the nearer they are in the element tree, and so are blocks of one
kind under one parent. The minimum cut is the labelling of least total cost:
ties and evidence outweigh the structure where they agree against it.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import map_texts

#: Markup, comments and text; a stray "<" counts as text.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'])([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template textarea title iframe svg select option button object canvas audio video map datalist".split())
#: Of these, the ones whose text is no markup: it runs to their own closing tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in "script style textarea title iframe noscript".split()}
#: An opening tag of these ends an open one of the second set.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ENDABLE = frozenset("p li dt dd tr td th".split())
ENDS |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}

BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note status".split())
#: Class and id names of parts that are never main text, and of parts that mostly are not.
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer form gdpr login masthead menu menubar modal nav navbar navigation navi "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion share sharing sidebar sidenav signup sponsor sponsored subscribe subscription".split()
)
WEAK_NAMES = frozenset("alert bylinks header links notification notifications reactions related reply replies respond responses search skip social tags teaser toolbar topbar widget widgets".split())
#: Names of the first set that mean the same whatever stands beside them.
PLAIN_NAMES = frozenset("advertisement advertising breadcrumb breadcrumbs commentlist consent cookie cookies disqus gdpr masthead navbar navigation newsletter pagination popup sidebar sidenav".split())
#: Parts of a class or id that leave the meaning of the parts beside them; with any other part beside it (notice-of-meeting, related-work) a name marks nothing.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons center cell clear col column container content desktop element entry fixed float global group head header holder icon inline inner item items label large left level line list main mobile "
    "module new outer page panel placeholder position post primary region right root row secondary section side site size slot small sticky strip sub table text thread title top unit view wrap wrapper zone".split()
)
#: A name with one of these beside it describes a layout (has-sidebar), not the element.
LAYOUT = frozenset("has have with without no show hide is enable enabled disable disabled".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Class names of these describe the whole page or article, so they don't mark it as boilerplate.
UNNAMED = CONTENT_TAGS | {"html", "body"}
CONTENT_NAMES = frozenset("article articlebody body content entry main post postbody postcontent story storybody text".split())

#: Costs of the structure's features: a block under a boilerplate element, one under an element that only names (or a form) call so, one under a content element, one under none of these (plus a share for each word, up to 24).
BOILER_COST, NAMED_COST, WEAK_COST, CONTENT_COST, OPEN_COST, WORD_COST = 5.0, 4.2, 2.8, 2.2, 0.3, 0.1
#: Cost of a block outside both that is all link.
LINK_COST = 3.0
#: Weights of the ties between neighbours (over 1 + the elements between them) and between blocks of one tag under one parent.
NEXT, SIBLING = 1.0, 0.45
#: The learned evidence moves a cost by this much at most, and one cue by this much.
EVIDENCE, CUE = 2.5, 1.0


class Place(NamedTuple):
    """A block element's place in the tree: the one around it, its depth, its number."""

    up: Place | None
    depth: int
    number: int


@dataclass
class Node:
    """An open element: its tag, its place (that of the nearest block element), and what it says of the text under it; `named` has the names that mark boilerplate."""

    tag: str
    place: Place
    boiler: bool
    named: frozenset
    content: bool
    hidden: bool


@dataclass
class Found:
    """A text block: raw pieces, its element's place, its zone (`named`: cost of the names), letters inside links, and letters inside inline elements that names mark, by their cost."""

    place: Place
    tag: str
    boiler: bool
    named: float
    content: bool
    pieces: list = field(default_factory=list)
    linked: int = 0
    told: dict = field(default_factory=dict)
    text: str = ""


def _parts(word: str) -> set[str]:
    """The parts of a class or id that tell what it marks, if they all do or are neutral; numbers are neutral."""
    parts = {p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower()) if p}
    if parts & LAYOUT:
        return set()
    if parts & (BOILER_NAMES | WEAK_NAMES) and not parts & PLAIN_NAMES and not parts <= BOILER_NAMES | WEAK_NAMES | NEUTRAL | CONTENT_NAMES:
        return parts & CONTENT_NAMES
    return parts


def _zone(tag: str, attrs: str, up: Node) -> tuple[bool, frozenset, bool, bool]:
    """(boilerplate, boilerplate names, content, hidden) of an element under `up`, by its tag, role, class and id.

    An article or main element ends a zone that only names or a form make,
    unless it has one of these names itself (an article per comment, say).
    """
    names: set[str] = set()
    hidden = up.hidden
    if attrs:
        for key, a, b, c in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                for word in value.split():
                    names |= _parts(word)
            elif key == "role":
                names.add("role:" + value.strip().lower())
            hidden = hidden or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())
    roles = {n[5:] for n in names if n.startswith("role:")}
    whole = tag in CONTENT_TAGS or bool(roles & {"main", "article"})
    good = whole or bool(names & CONTENT_NAMES)
    bad = tag in BOILER_TAGS or (tag == "header" and not up.content) or (bool(roles & BOILER_ROLES) and tag not in CONTENT_TAGS)
    named = frozenset() if whole and not names & up.named else up.named
    if not whole and tag not in UNNAMED:
        named |= names & (BOILER_NAMES | WEAK_NAMES)
        if tag == "form":
            named |= {"form"}
    return up.boiler or bad, named, (up.content or good) and not bad and not named, hidden


def _name_cost(named: frozenset) -> float:
    return NAMED_COST if named & BOILER_NAMES else WEAK_COST if named else 0.0


def blocks(page: str) -> list[Found]:
    """Text blocks of a page in page order; scripts, styles, comments and hidden parts are left out.

    Only block elements divide text. An inline element that names mark counts
    for a block if most of the block's text lies in such elements. Time is
    linear in the page, however deep its elements lie in each other.
    """
    top = Place(None, 0, 0)
    stack = [Node("", top, False, frozenset(), False, False)]
    outer = [0]  # where in the stack block elements are
    opened: dict[str, int] = {}
    made, current, count, skip, at = [], None, 0, "", 0

    def shut(depth: int) -> None:
        for n in stack[depth:]:
            opened[n.tag] -= 1
        del stack[depth:]
        while outer[-1] >= depth:
            outer.pop()

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attrs = m.group(1), m.group(2), m.group(3)
        if tag is None:
            piece = m.group()
            if not skip and piece[0] != "<" or piece == "<" and not skip:
                here = stack[-1]
                if here.hidden or (current is None and piece.isspace()):
                    continue
                holder = stack[outer[-1]]
                if current is None:
                    current = Found(holder.place, holder.tag, here.boiler, _name_cost(holder.named), holder.content or here.content)
                    made.append(current)
                current.pieces.append(piece)
                if opened.get("a"):
                    current.linked += len(piece)
                if here.named != holder.named:
                    cost = _name_cost(here.named)
                    current.told[cost] = current.told.get(cost, 0) + len(piece)
            continue
        tag = tag.lower()
        if tag in RAW and not closing and not attrs.rstrip().endswith("/"):
            end = RAW[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        if skip:
            if closing and tag == skip:
                skip = ""
            continue
        if tag in BREAKS:
            current = None
        elif tag == "br" and current is not None:
            current.pieces.append(" ")
        if closing:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                shut(depth)
            continue
        if tag in UNREAD:
            if not attrs.rstrip().endswith("/"):
                skip = tag
            continue
        for out in ENDS.get(tag, ()):
            if opened.get(out):
                depth = next(d for d in reversed(outer) if stack[d].tag == out or stack[d].tag not in ENDABLE)
                if stack[depth].tag == out:
                    shut(depth)
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        count += 1
        up = stack[-1]
        boiler, named, content, hidden = _zone(tag, attrs, up)
        if tag in BREAKS:
            outer.append(len(stack))
        stack.append(Node(tag, Place(up.place, up.place.depth + 1, count) if tag in BREAKS else up.place, boiler, named, content, hidden))
        opened[tag] = opened.get(tag, 0) + 1
    for b in made:
        b.text = " ".join(entities.unescape("".join(b.pieces)).split())
        marked = sum(b.told.values())
        if marked and 2 * marked > sum(map(len, b.pieces)):
            b.named = max(b.named, *b.told)
            b.content = False
    return [b for b in made if b.text]


def cues(b: Found, place: float) -> tuple[str, ...]:
    """What a block shows apart from its zone: the features of the learned evidence."""
    words = b.text.count(" ") + 1
    link = min(4, 4 * b.linked // max(1, len(b.text)))
    return f"tag:{b.tag}", f"words:{min(8, words.bit_length())}", f"links:{link}", f"end:{b.text[-1] in '.!?:;'}", f"place:{int(4 * place)}", f"stops:{min(4, b.text.count('. '))}"


def least_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of a minimum cut: costs[i] > 0 is the price of calling i boilerplate, < 0 of calling it content.

    Nodes whose own cost outweighs their ties are settled first, which leaves
    the minimum as it is; augmenting paths solve what remains.
    """
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    cost, label, todo = list(costs), [None] * n, deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = cost[i] >= 0
            for j, w in near[i].items():
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, cost, near), strict=True):
            label[i] = side
    return label


def _max_flow(rest: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut, by shortest augmenting paths."""
    at = {v: k for k, v in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for v in rest:
        a, b, w = (source, at[v], cost[v]) if cost[v] > 0 else (at[v], sink, -cost[v])
        room[a][b], room[b][a] = w, 0.0
        for u, w in near[v].items():
            if u in at:
                room[at[v]][at[u]] = w
    while True:
        back, queue = {source: source}, deque([source])
        while queue and sink not in back:
            a = queue.popleft()
            for b, w in room[a].items():
                if w > 1e-9 and b not in back:
                    back[b] = a
                    queue.append(b)
        if sink not in back:
            return [k in back for k in range(len(rest))]
        path, b = [], sink
        while b != source:
            path.append((back[b], b))
            b = back[b]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push


def main_text(page: str | None, evidence: dict[str, float]) -> str:
    """The content blocks of a page, joined by single spaces; empty for null and for pages without any."""
    found = blocks(page or "")
    if not found:
        return ""
    costs, ties = terms(found, evidence)
    return " ".join(b.text for b, keep in zip(found, least_cut(costs, ties), strict=True) if keep)


def terms(found: list[Found], evidence: dict[str, float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The cost of each block (positive: of calling it boilerplate) and the ties (block, block, weight)."""
    costs, ties, last = [], [], {}
    for i, b in enumerate(found):
        learned = sum(max(-CUE, min(CUE, evidence.get(c, 0.0))) for c in cues(b, i / len(found)))
        if b.boiler:
            zone = -BOILER_COST
        elif b.named:
            zone = -b.named
        elif b.content:
            zone = CONTENT_COST
        else:
            zone = OPEN_COST + WORD_COST * min(24, b.text.count(" ") + 1) - LINK_COST * min(1.0, b.linked / len(b.text))
        costs.append(zone + max(-EVIDENCE, min(EVIDENCE, learned)))
        if i:
            ties.append((i - 1, i, NEXT / (1 + _apart(found[i - 1].place, b.place))))
        kind = (b.place.up.number if b.place.up else 0, b.tag)
        if kind in last:
            ties.append((last[kind], i, SIBLING))
        last[kind] = i
    return costs, ties


def _apart(a: Place, b: Place) -> int:
    """Elements to leave and to enter on the way from one block to another; between neighbours, all of them are linear in the page."""
    steps = 0
    while a.number != b.number:
        if a.depth >= b.depth:
            a, steps = a.up, steps + 1
        else:
            b, steps = b.up, steps + 1
    return steps


def learn_evidence(pages: DataFrame) -> dict[str, float]:
    """Log-ratio of each cue between blocks that the page's structure marks as content and as boilerplate.

    Counts cover all pages; each task adds up its own first. There are only a
    few dozen cues. Without marked blocks of both kinds there is no evidence.
    """

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                for i, b in enumerate(found):
                    if b.boiler or (b.content and not b.named):
                        for c in cues(b, i / len(found)):
                            counts.setdefault(c, [0, 0])[0 if b.boiler else 1] += 1
        rows = [(c, n[0], n[1]) for c, n in sorted(counts.items())]
        yield pa.RecordBatch.from_pydict({"cue": pa.array([r[0] for r in rows], pa.string()), "n0": pa.array([r[1] for r in rows], pa.int64()), "n1": pa.array([r[2] for r in rows], pa.int64())})

    rows = pages.select("html").mapInArrow(run, "cue string, n0 long, n1 long").groupBy("cue").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
    total = np.array([[r.n0, r.n1] for r in rows if r.cue.startswith("end:")]).sum(axis=0) if rows else np.zeros(2)
    if not total.min():
        return {}
    return {r.cue: 0.5 * float(np.log((r.n1 + 1) / (total[1] + 2)) - np.log((r.n0 + 1) / (total[0] + 2))) for r in rows}


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, plus text and n_chars (code points).

    Null and empty pages give empty text; repeated rows give equal texts;
    columns of pages called text or n_chars give way, all others stay.
    """
    evidence = learn_evidence(pages)
    made = map_texts(pages.drop("text", "n_chars"), lambda: lambda texts: {"text": [main_text(t, evidence) for t in texts]}, T.StructType().add("text", "string"), text="html")
    return made.withColumn("n_chars", F.length("text").cast("long"))
