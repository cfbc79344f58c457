"""Classifier, language model, language identification and near duplicates."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from palisade.llm import langid, lm, neardup, quality
from palisade.llm.tokens import Words
from palisade.llm.trie import EliasFano, Trie


def docs_of(spark, sf, n=None):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d


EDGE = [(None, None, "en", "s", 0), (None, "", None, None, 0), (-1, "a b", "en", "s", 0), (-1, "a b", "en", "s", 0), (-2, "   ", "en", "s", 0), (-3, "long word " * 20_000, "en", "s", 0)]


def with_edges(spark, sf):
    d = docs_of(spark, sf)
    return d.unionByName(spark.createDataFrame(EDGE, d.schema))


def test_quality_held_out(spark, sf):
    d, labels = with_edges(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    y = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.9 * len(held)
    assert quality.keep_good(d, labels).columns == d.columns


def test_quality_without_labels(spark, sf):
    d, labels = docs_of(spark, sf).limit(5), spark.read.parquet(f"{sf}/labels.parquet")
    assert {r.score for r in quality.score_documents(d, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(d.limit(0), labels).count() == 0


def test_hinge_separates():
    rng = np.random.default_rng(0)
    y_ = rng.choice([-1.0, 1.0], 200)
    rows = [np.array(sorted({0, int(rng.integers(2, 50)), 1 if y > 0 else 50})) for y in y_]
    w = quality.fit_hinge(rows, y_, np.ones(51))
    assert all((w[r].sum() > 0) == (y > 0) for r, y in zip(rows, y_, strict=True))


def test_language_model(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 50_000)
    d = with_edges(spark, sf)
    got = lm.score_documents(d).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low)) + ["</s>"]) for r in d.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, pairs, first = Counter(), Counter(), Counter()
    for i, words in rows:
        if not held(i):
            before = ["<s>"] + words[:-1]
            c.update(words), pairs.update(zip(before, words, strict=True)), first.update(before)
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    want = []
    for i, words in rows:
        before = ["<s>"] + words[:-1]
        s = sum(math.log10(pairs[u, w] / (first[u] + lm.MU) + lm.MU / (first[u] + lm.MU) * p(w)) for u, w in zip(before, words, strict=True))
        want.append((str(i), held(i), len(words), sum(c[w] > 0 for w in words), n, sum(math.log10(p(w)) for w in words), s))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=0.02)
    assert lm.score_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(0, 5000, 7)), sorted(random.Random(1).randrange(1 << 50) for _ in range(3000))])
def test_elias_fano(tmp_path, values):
    ef = EliasFano.write(np.array(values, dtype=np.uint64), tmp_path / "x")
    targets = np.array(values[:50] + [3, 10**15 + 1], dtype=np.uint64)
    for t, at in zip(targets.tolist(), ef.find(targets).tolist(), strict=True):
        assert (at >= 0 and values[at] == t) if t in values else at == -1
    places = np.arange(len(values))
    assert ef.access(places).tolist() == values
    if values:
        half = len(values) // 2
        found = ef.find(targets, half, np.full(len(targets), len(values)))
        assert all((at >= half and values[at] == t) if t in values[half:] else at == -1 for t, at in zip(targets.tolist(), found.tolist(), strict=True))
        assert isinstance(ef.words.base, np.memmap) and isinstance(ef.rows, np.memmap)


def test_trie(tmp_path):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(1 << 60), rng.randrange(1 << 48) << 16) for _ in range(500)} | {(7, rng.randrange(1 << 48) << 16) for _ in range(900)} | {(9, 0)})
    contexts, runs = np.unique(np.array([p[0] for p in pairs], dtype=np.uint64), return_counts=True)
    words, logs = np.array([p[1] for p in pairs], dtype=np.uint64), np.array([-rng.random() * 6 for _ in pairs])
    trie = Trie(tmp_path, contexts, runs, words, logs)
    got = Trie.probabilities(trie.lookup(np.repeat(contexts, runs), words), trie.low, trie.high)
    assert np.abs(np.log10(got) - logs).max() <= 6 / 254 / 2 + 1e-9
    assert not trie.lookup(np.array([7, 8, 9], dtype=np.uint64), np.array([words[0] + np.uint64(1), 0, words[-1]], dtype=np.uint64)).any()
    # Bits a pair: successors and codes stay compact.
    assert sum(f.stat().st_size for f in tmp_path.iterdir() if f.stem in ("successors", "codes")) < 4 * len(pairs)
    empty = np.zeros(0, dtype=np.uint64)
    (tmp_path / "e").mkdir()
    assert Trie(tmp_path / "e", empty, np.zeros(0, dtype=np.int64), empty, np.zeros(0)).lookup(contexts[:3], words[:3]).tolist() == [0, 0, 0]


def test_long_words_hash_apart():
    a = "x" * 4096 + "a" + "y" * 4095 + "b"
    assert Words([a]).hash[0] != Words([a.replace("a", "c").replace("b", "a").replace("c", "b")]).hash[0] and Words(["a" + "x" * 4095 + "b"]).hash[0] != Words(["b" + "x" * 4095 + "a"]).hash[0]


def test_language_identification(spark, sf):
    d = with_edges(spark, sf)
    got = langid.identify_languages(d).collect()
    assert len(got) == d.count()
    truth = {r.doc_id: (r.lang, len(r.text)) for r in docs_of(spark, sf).collect()}
    held = [r for r in got if r.held_out and truth.get(r.doc_id, ("", 0))[1] > 100]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.9 * len(held)
    assert [r.lang_pred for r in got if r.doc_id == -2] == ["und"] and all(0 <= r.score <= 1 for r in got)
    none = d.limit(3).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify_languages(none).collect()} == {"und"}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_NODES", 7)  # many chunks per cluster
    monkeypatch.setattr(neardup, "CHUNK_BUCKET", 5)
    monkeypatch.setattr(neardup, "TASK_ROWS", 100)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [" ".join(base)] * 3 + [" ".join(base).upper()]
    for i in range(30):
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(50)) for _ in range(10)] + [None, "", "...", "one two", "one two", "one two three"]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[5], "z"), (0, texts[0], "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, node string")
    sets = [frozenset(s.tolist()) for s in neardup.shingle_sets([t for _, t, _ in rows])]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9 and bool(a)
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if alike(a, b):
                    group[i] = group[j] = min(group[i], group[j])
    distinct = set(sets)
    want = sorted((str(i), str(min([rows[k][0] for k in range(len(rows)) if group[k] == group[n] and rows[k][0] is not None], default=None)), sum(alike(sets[n], s) for s in distinct if s != sets[n])) for n, (i, _, _) in enumerate(rows))
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in neardup.near_duplicates(d).collect())
    assert got == want
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and kept.count() == len({g for g, s in zip(group, sets, strict=True) if s}) + sum(not s for s in sets)
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_bayes_thresholds():
    assert neardup.least_matches(24) < 0.8 * 24 and neardup.least_matches(240) > 0.5 * 240


def all_pairs(texts):
    """(least index of each text's class, links to other distinct sets) by comparing all pairs of sets."""
    sets = [frozenset(s.tolist()) for s in neardup.shingle_sets(texts)]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), min(s)))
    links = {s: set() for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(a) < 0.8 * len(b) - 1e-9:
                break
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[a].add(b), links[b].add(a)
    least = {}
    for i, s in enumerate(sets):
        if s and s not in least:
            todo = [s]
            while todo:
                t = todo.pop()
                if t not in least:
                    least[t] = i
                    todo += links[t]
    return [least.get(s, i) for i, s in enumerate(sets)], [len(links.get(s, ())) for s in sets]


def test_near_duplicates_of_a_whole_table(spark, sf):
    rows = docs_of(spark, sf).orderBy("doc_id").collect()
    least, links = all_pairs([r.text for r in rows])
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, sf)).collect()}
    assert [(got[r.doc_id].class_id, got[r.doc_id].n_links) for r in rows] == [(rows[i].doc_id, n) for i, n in zip(least, links, strict=True)]
    assert sum(n > 0 for n in links) > 3


def test_a_chain_is_compared_in_near_linear_time():
    words = [f"w{i}" for i in range(9_000)]
    texts = [" ".join(words[4 * i : 4 * i + 50]) for i in range(2_000)]
    sets = neardup.shingle_sets(texts)
    values = [neardup.minhashes(s) for s in sets]
    bands, every = np.stack([neardup._bands(v) for v in values]), np.arange(len(sets))
    signatures = np.stack([np.frombuffer(neardup._signature(v), dtype=np.uint8) for v in values])
    count, root, compared = neardup._links(sets, signatures, bands, every, every, True)
    assert count.tolist() == [1, *[2] * 1998, 1] and set(root) == {0}
    assert compared < 20 * len(sets)
    stars = neardup._stars(every, every, True, signatures, np.array([len(s) for s in sets]))
    assert len(stars) == len(sets) - 1 and {r for _, r in stars} == {0}
