"""Merkle manifest, conversation repair and token counts against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
import public_tokenizers
import sentencepiece
from palisade.llm import conversations, manifest_tree, token_counts

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    by = {}
    for doc_id, source, lang, n, text in rows:
        low = text and text.translate({c: c + 32 for c in range(65, 91)})
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = sha(map(enc, (doc_id, source, lang, n, text)))
        by.setdefault(source, []).append((doc_id, leaf, sha(map(enc, (doc_id, source, lang, n, low))) if bad else leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in by[s]])
    top, out = tree([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, now) in enumerate(by[s]):
            beside = []
            for levels, j in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[j // 16 * 16 : j // 16 * 16 + 16]
                    beside += run[: j % 16] + run[j % 16 + 1 :]
                    now = sha([*run[: j % 16], now, *run[j % 16 + 1 :]])
                    j //= 16
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha(beside), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [256, 257, 3], [5000, *[2] * 40]])
def test_manifest(spark, sizes):
    rows = [(None if i % 50 == 49 else i // 2 * 2, None if s == 1 else f"s{s}é", "e" if i % 3 else None, i, f"Text {i}" if i % 7 else None) for s, n in enumerate(sizes) for i in range(n)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, FIELDS).repartition(3)
    got = sorted((tuple(r) for r in manifest_tree.manifest_summary(docs).collect()), key=str)
    assert got == plain_manifest(rows)


def test_versions_share_all_but_a_path(spark):
    rows = [(i, f"s{i % 3}", "e", i, f"Text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, FIELDS + ", extra string".replace(", extra string", "")).selectExpr("*", "'x' as key", "1 as pos", "2 as copies")
    got = manifest_tree.versions(docs).collect()
    for r in got:
        assert (r.copies is None) == r.verified
        if r.copies:  # 334 leaves a source: three levels above a leaf, then one of sources
            assert [(c.level) for c in r.copies] == [0, 1, 2, 3, 4] and r.copies[-1].digest == r.folded_root
            assert all(a.idx // 16 == b.idx for a, b in zip(r.copies[:3], r.copies[1:3], strict=False))
    assert manifest_tree.versions(docs.limit(0)).collect() == []


def test_persistent_tree():
    tree = manifest_tree.grown([sha([str(i)]) for i in range(200)], 2)
    path = manifest_tree.path_of(77, 2)
    other = manifest_tree.copied(tree, path, "x")
    assert sum(a is not b for a, b in zip(tree.below, other.below, strict=True)) == 1 and tree.below[4].below[13].digest == sha(["77"])
    assert other == manifest_tree.grown([sha([str(i)]) if i != 77 else "x" for i in range(200)], 2)


def plain_repair(rows):
    """Every cheapest edit list by Dijkstra over (cost, letters)."""
    by = {}
    for conv, turn, role, text in rows:
        some = lambda v: " " if v is None else v
        fault = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    grammar, out = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}, []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            end = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns, initials = {r[0] for r in mine} - {None}, [r[1][:1] for r in mine]
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, said = heapq.heappop(heap)
            if i == len(mine) and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            for x, name in (("u", "user"), ("a", "assistant")):
                if x in grammar[state]:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, x, (*said, name + ":")))
            if i < len(mine):
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
                if faults[i] in ("", "truncated"):
                    more = 3 if faults[i] else 0
                    if initials[i] in grammar[state]:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i], (*said, f"{mine[i][1]}:{mine[i][2]}")))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if x in grammar[state]:
                            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, x, (*said, f"{name}:{mine[i][2]}")))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(["\n".join(said)])))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["3", "30"])
def test_repair(spark, partitions):
    """Conversations of all sizes; with many partitions the long one spans tasks."""
    rng, rows = random.Random(int(partitions)), []
    for conv in [None, *range(40)]:
        for t in range(600 if conv == 7 else rng.choice([1, 3, 10, 40])):
            rows.append((conv, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Hi.", "no", "", "  ", None, f"x{t}.", f"y{t}!\n", f"cut {t}"])))
    rows += rows[:50]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'k' as key", "1 as seq", "'e' as edit", "0 as copies")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted((tuple(r) for r in conversations.repair_summary(frame).collect()), key=str) == plain_repair(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert conversations.repair_summary(frame.limit(0)).count() == 0


def test_checkpoints_hold_a_root_of_the_rows():
    rows = [conversations.row_of(r, f) for r, f in zip("suauaxau" * 500, [0, 0, 3, 0, 2, 1, 0, 3] * 500, strict=True)]
    edits = "".join(e for e, _, _ in conversations.walk(rows, conversations.END, 0, True))
    v = conversations.END
    for r in reversed(rows):
        v = conversations.before(r, v)
    cost = sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in edits)
    i = 0
    for e in edits:
        if e != "I":
            cost += 3 if e in "KR" and rows[i][1] == conversations.TRUNCATED else 0
            i += 1
    assert cost == v[0] and i == len(rows)


ODD = [None, "", " ", "  ", "a ", " a", "\n", "\n\na", " \n", "a \nb", "a\n b", "▁", "a▁ b", "a  b\n\n  c  ", "<s> x </s>", "é\x00\t x", "  a\r\nb", "x" * 300, "日本語 テキスト\n🙂 🙂🙂", "  \n  \n", " ▁ \n▁", "<unk>", "long " * 5000]


@pytest.mark.parametrize("long", [token_counts.LONG, 2])
def test_token_counts(spark, sf, monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([" ", " ", "\n", "▁", "a", "the", "Tion", "é", ".", "  ", "🙂"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame([(i if i else None, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, over_limit string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i if i else None]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096), t
    assert token_counts.token_summary(docs.limit(0)).collect() == []


def test_the_table_changes_no_count(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.n_tokens for r in token_counts.token_summary(docs).collect()}
    monkeypatch.setattr(token_counts, "frequent_pretokens", lambda *a: ["the", "", "no such thing"])
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_summary(docs).collect()} == want
    with pytest.raises(OSError):
        token_counts.model_bytes("/no/such/model")
