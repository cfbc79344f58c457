"""Classifier, language identification and the pipeline against plain versions without Spark."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import zstandard
from palisade.llm import langid, lines, mixing, quality
from pyspark.sql import functions as F
from test_models import all_pairs
from test_native import water_fill
from test_text import brute


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit("fit"), "doc_id").alias("at"), F.xxhash64("text").alias("tie")).collect()
    y = {r.doc_id: r.quality for r in labels.collect()}
    known = [r for r in rows if r.doc_id in y and crc(r.doc_id) % 3 != 1]
    f = {r.doc_id: quality.features(r.text) for r in rows}
    pair = np.full((2, quality.N_FEATURES), quality.SMOOTH)
    for r in known:
        for k in f[r.doc_id].tolist():
            pair[y[r.doc_id], k] += 1
    ratio = np.log(pair[1] / pair[1].sum()) - np.log(pair[0] / pair[0].sum())
    ratio[-1] = np.abs(ratio[:-1]).sum() / len(ratio) + abs(ratio[-1]) / len(ratio)
    ordered = sorted(known, key=lambda r: (r.at, r.doc_id, r.tie))
    ordered = [r for c in (0, 1) for r in ordered if y[r.doc_id] == c]
    assert len(ordered) <= quality.MAX_FIT
    # Dual coordinate descent with dense vectors.
    vectors = []
    for r in ordered:
        v = np.zeros(quality.N_FEATURES)
        v[f[r.doc_id]] = ratio[f[r.doc_id]]
        vectors.append(v / np.sqrt((v**2).sum()))
    w, alpha, rng = np.zeros(quality.N_FEATURES), [0.0] * len(ordered), np.random.default_rng(7)
    for _ in range(quality.PASSES):
        for i in rng.permutation(len(ordered)):
            sign = 1 if y[ordered[i].doc_id] else -1
            new = max(alpha[i] - (sign * (w @ vectors[i]) - 1 + alpha[i] / (2 * quality.COST)) / (1 + 1 / (2 * quality.COST)), 0.0)
            w += (new - alpha[i]) * sign * vectors[i]
            alpha[i] = new
    w = (1 - quality.MEAN_SHARE) * w + quality.MEAN_SHARE * np.abs(w).mean()
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    for r in rows:
        x = ratio[f[r.doc_id]]
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-6 * (w[f[r.doc_id]] @ x) / math.sqrt(x @ x))), abs_tol=2e-3)


@pytest.mark.parametrize("text", ["", "a", "Ab", "the cat, the cat", "ß é"])
def test_quality_features(text):
    raw = text.encode()
    grams = {b for b in raw} | {(256 + (((a << 8 | b) * 2654435761 % 2**32) >> (32 - quality.BITS + 1))) % 2**quality.BITS for a, b in zip(raw, raw[1:], strict=False)}
    grams |= {((a << 16 | b << 8 | c) * 2246822519 % 2**32) >> (32 - quality.BITS) for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)}
    got = set(quality.features(text).tolist())
    assert grams | {quality.N_FEATURES - 1} <= got and len(got - grams) <= 1 + 2 * len(raw) + 24


def test_language_by_smallest_size(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    contents = langid.learn(docs)
    pool = defaultdict(set)
    for r in rows:
        if crc(r.doc_id) % 4 != 2:
            pool[r.lang].update(langid.plain(r.text).split())
    for lang, data in contents.items():  # words at the ends of an excerpt may be cut
        assert sum(w in pool[lang] for w in data.split()) >= 0.98 * len(data.split())
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    for r in rows:
        sizes = []
        for data in contents.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(langid.plain(r.text))))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = sorted(sizes)[1]
        margin = (second - sizes[best]) / second
        assert got[r.doc_id].lang_pred == list(contents)[best] and math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-langid.STEEP * margin)))
        assert got[r.doc_id].rejected == (margin < langid.MARGIN)
    assert langid.identify_languages(docs.limit(0)).count() == 0
    assert langid.identify_languages(docs.limit(2).selectExpr("*", "1 as lang_pred", "2 as score")).columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]


def without_shared_lines(rows):
    sites, first, bare = defaultdict(set), {}, lambda x: x.strip(" \t\r")
    for r in rows:
        for line in map(bare, r["text"].split("\n")):
            if line:
                sites[line].add(r["source"] or "")
                first[line] = min(first.get(line, r["doc_id"]), r["doc_id"])
    gone = {x for x, s in sites.items() if len(s) >= (lines.SHORT_SITES if len(x) < lines.MIN_CHARS else lines.MIN_SITES)}
    out = []
    for r in rows:
        text = "\n".join(x for x in r["text"].split("\n") if bare(x) not in gone or first[bare(x)] == r["doc_id"])
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def test_pipeline_rows(spark, sf):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    score = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    rows = sorted((r.asDict() for r in docs.collect() if score[r.doc_id] >= 0.5), key=lambda r: r["doc_id"])
    rows = without_shared_lines(rows)
    least, _ = all_pairs([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if least[i] == i]
    marks = brute([r["text"] for r in rows], [(r.item_id, r.text) for r in bench.collect()])
    rows = [r for r, m in zip(rows, marks, strict=True) if not m[4]]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].encode().translate(bytes(32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))).split(b" ")) - r["text"].encode().translate(bytes(32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))).split(b" ").count(b"")
    target = water_fill(sizes)
    want = Counter()
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        own = hashlib.md5(r["text"].encode()).hexdigest()
        u = int(hashlib.sha256(f"{mixing.SEED}|{r['doc_id']}|{r['source']}|{own}".encode()).hexdigest()[:13], 16) / 2**52
        for copy in range(1, 1 + math.floor(rate) + (u < rate - math.floor(rate))):
            want[r["doc_id"], r["text"], r["n_chars"], r["source"], copy] += 1
    got = Counter((r.doc_id, r.text, r.n_chars, r.source, r.copy) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and got


def test_pipeline_stages_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).withColumns({"_hits": F.lit("h"), "band": F.lit(1), "copies": F.lit(2), "k1": F.lit("k")})
    odd = spark.createDataFrame([(None, None, None, None, None, "h", 1, 2, "k"), (None, "", "en", "s", 0, "h", 1, 2, "k"), (7, "same text twice", "en", "s", 15, "h", 1, 2, "k"), (7, "same text twice", "en", "s", 15, "h", 1, 2, "k"), (None, "w " * 50_000, "en", None, 100_000, "h", 1, 2, "k")], docs.schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for some in (docs.unionByName(odd), docs.limit(0)):
            out = stage(spark, some, sf)
            assert out.columns == (docs.columns if k < 4 else [*docs.columns, "copy"])
            assert out.filter("_hits <> 'h' or band <> 1 or copies <> 2 or k1 <> 'k'").count() == 0
