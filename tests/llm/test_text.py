"""Decontamination, HTML extraction, media columns and the pipeline."""

import hashlib
import re
import zlib

import corpus_pipeline
import pytest
from palisade.llm import decontaminate, html, media
from pyspark.sql import functions as F


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for g, ids in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= ids
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [10**6, 3])
def test_decontamination(spark, most):
    item = " ".join(f"q{i}" for i in range(30))
    items = [(1, item), (2, "Short, item!"), (3, None), (4, ""), (5, item)]
    texts = [None, "", "SHORT item", "a short-item b short item", " ".join(["pad"] * 5000) + " " + " ".join(f"Q{i}" for i in range(3, 20)), item + " x " + item, "q0 q1 q2", "É é ß short"] * 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontaminate.find_contamination(d, b, most).collect())
    assert [tuple(r)[1:] for r in got] == brute(texts, items)
    clean = decontaminate.drop_contaminated(d.withColumn("_c1", F.lit(1)), b, most)
    assert clean.columns == ["doc_id", "text", "_c1"] and clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.find_contamination(d, b.limit(0), most).filter("n_hit > 0").count() == 0


def cost_of(labels, costs, ties):
    return sum(abs(c) for c, side in zip(costs, labels, strict=True) if (c > 0) != side and c) + sum(w for a, b, w in ties if labels[a] != labels[b])


def test_least_cut_is_least():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        best = min(cost_of(x, costs, ties) for x in itertools.product([False, True], repeat=n))
        assert abs(cost_of(html.least_cut(costs, ties), costs, ties) - best) < 1e-9


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One  <b>two</b>
three.<p>Four &lt;five&gt;<br>six<div class="ad">Buy</div><script>var t="</p>";</script><!-- x --></article>
<div id="comments"><p>Nice!</p></div><aside>Side</aside><form>Mail</form><footer>End</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (5, "u", "<p>plain &eacute;&#33; text"), (5, "u", "<p>plain &eacute;&#33; text"), (6, "u", "<article>" + "<p>w w</p>" * 5000)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & tail One two three. Four <five> six"
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[5].text == "plain é! text" and got[5].n_chars == 13
    assert got[6].text == " ".join(["w w"] * 5000)


def test_html_template_pages(spark, sf):
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        assert r.text == " ".join(entities.unescape(re.sub("<[^>]+>", " ", article)).split())


def test_media(spark, monkeypatch):
    texts = [None, "", "é" * 288, "a" * 577, "b" * 200_000, "b" * 200_000]
    d = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, name string")
    got = {r.doc_id: r for r in media.media_columns(d).collect()}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        whole = body + b"\xff" * ((-len(body)) % 576 if body else 576)
        r = got[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    assert media.media_columns(d.limit(0)).count() == 0


def test_media_retries_members(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(2)
    media.write_media(d, str(tmp_path / "arch"))
    assert media.read_media(spark, str(tmp_path / "arch"), range_bytes=3000).select("name").distinct().count() == 40
    reader = media.ArchiveReader(str(tmp_path / "arch"), 10**9)
    part = [p for p in reader.partitions() if p.stop > p.start][0]
    checked, failed = media.ArchiveReader._checked, []

    def flaky(block, length, crc):
        if not failed:
            failed.append(1)
            raise OSError("lost")
        return checked(block, length, crc)

    reader._checked = flaky
    n = sum(b.num_rows for b in reader.read(part))
    assert failed and n == sum(b.num_rows for b in media.ArchiveReader(str(tmp_path / "arch"), 10**9).read(part))
    bad = next(p for p in (tmp_path / "arch").iterdir() if p.name == part.name)
    data = bytearray(bad.read_bytes())
    data[700] ^= 1
    bad.write_bytes(data)
    with pytest.raises(OSError, match="offset 0"):
        list(media.ArchiveReader(str(tmp_path / "arch"), 10**9).read(part))


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == (columns if k < 4 else [*columns, "copy"])
    want = docs.count()
    assert corpus_pipeline.run(spark, sf).count() == want
    assert corpus_pipeline.STAGES[2][1](spark, spark.read.parquet(str(tmp_path / "1")).limit(0), sf).count() == 0
