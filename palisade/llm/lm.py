"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Documents are cut into blocks. A block asks each shard for what it needs: its
distinct words go to the shard of the word, its distinct word pairs to the
shard of the first word, with their counts in training texts. A shard adds up
the counts of all blocks, builds its trie, and answers every block with word
counts and quantised probabilities. A block then scores its own documents.
Only distinct words and pairs travel, so a frequent word costs each block one
entry; pairs of very frequent first words are dealt out further by their
second word.
"""

from __future__ import annotations

import hashlib
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from palisade.llm.spans import cut_table, slices
from palisade.llm.tokens import SPACED, Words, mix64
from palisade.llm.trie import Trie

#: Characters of a block, and bytes of text per shard (sizes of a task's work, whatever the input's size).
BLOCK_CHARS, SHARD_BYTES = 2_500_000, 5_000_000
#: Weight of the word's own probability in pair smoothing, in counts.
MU = 300.0
#: Bytes of text that the routing of frequent contexts is planned on. It moves work between tasks; results do not depend on it.
PLAN_BYTES = 8_000_000

END, BEGIN = np.uint64(0x5151515151515151), np.uint64(0x2323232323232323)
ASK = "shard int, block binary, words binary, counts binary, contexts binary, totals binary, runs binary, next binary, pairs binary"
ANSWER = "block binary, shard int, counts binary, codes binary, low double, high double, n long, v long"


def learns(doc_id: Column) -> Column:
    """Rows that the model may learn from."""
    return F.crc32(doc_id.cast("string")) % 5 != 1


def _pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte plane by byte plane (the upper ones compress away)."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Small numbers, byte plane by byte plane."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _pack6(keys: np.ndarray) -> bytes:
    """The upper 48 bits of hashes."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    whole = np.zeros((len(part), 8), dtype=np.uint8)
    whole[:, 2:] = part
    return whole.view(np.uint64).ravel()


class Block:
    """Tokens of some texts: distinct words, distinct pairs, and each token's place in both."""

    def __init__(self, texts: list):
        w = Words(texts, SPACED)
        sizes = w.last - w.first + 1
        tokens = np.insert(w.hash, w.last, END)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        context = np.concatenate([[BEGIN], tokens[:-1]]).astype(np.uint64)
        context[np.cumsum(sizes) - sizes] = BEGIN
        self.n_docs, self.sizes = len(texts), sizes
        self.words, both = np.unique(np.concatenate([tokens, context]), return_inverse=True)
        self.word, self.context = both[: len(tokens)], both[len(tokens) :]
        code, self.pair = np.unique(self.context * len(self.words) + self.word, return_inverse=True)
        self.first, self.second = code // len(self.words), code % len(self.words)

    def parts(self, shards: int, hot: dict[int, int]):
        """(shard, its words, its hot contexts, its pairs, each pair's place among words and hot contexts), in the order both passes use."""
        of_word = (mix64(self.words) % np.uint64(shards)).astype(np.int64)
        salts = np.array([hot.get(int(x), 0) for x in self.words], dtype=np.uint64)
        many = salts[self.first] > 0
        salt = mix64(self.words[self.second] + np.uint64(7)) % np.maximum(salts[self.first], np.uint64(1))
        of_pair = np.where(many, (of_word[self.first] + salt.astype(np.int64)) % shards, of_word[self.first])
        extra: list[list[int]] = [[] for _ in range(shards)]
        for i in np.flatnonzero(salts):
            for k in range(int(salts[i])):
                extra[(of_word[i] + k) % shards].append(int(i))
        by_word, by_pair = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
        edges = np.arange(shards + 1)
        at_word, at_pair = np.searchsorted(of_word[by_word], edges), np.searchsorted(of_pair[by_pair], edges)
        for s in range(shards):
            ws, ps, hs = by_word[at_word[s] : at_word[s + 1]], by_pair[at_pair[s] : at_pair[s + 1]], np.array(extra[s], dtype=np.int64)
            if len(ws) or len(hs):
                place = np.where(many[ps], len(ws) + np.searchsorted(hs, self.first[ps]), np.searchsorted(ws, self.first[ps]))
                order = np.argsort(place, kind="stable")
                yield s, ws, hs, ps[order], place[order]

    def asks(self, train: np.ndarray, shards: int, hot: dict[int, int]):
        """(shard, words, counts, contexts, totals, runs, next, pairs) for each shard that is asked.

        A word's count is also its total as a context; only hot contexts, whose
        pairs are dealt out, send their totals to all of their shards.
        """
        learned = train[self.doc]
        words = np.bincount(self.word[learned], minlength=len(self.words)).astype(np.uint32)
        totals = np.bincount(self.context[learned], minlength=len(self.words)).astype(np.uint32)
        pairs = np.bincount(self.pair[learned], minlength=len(self.first)).astype(np.uint32)
        for s, ws, hs, ps, place in self.parts(shards, hot):
            runs = np.bincount(place, minlength=len(ws) + len(hs)).astype(np.uint32)
            yield s, _pack(self.words[ws]), _planes(words[ws]), _pack(self.words[hs]), _planes(totals[hs]), _planes(runs), _pack6(self.words[self.second[ps]]), _planes(pairs[ps])


def _blocks(docs: DataFrame, make, schema) -> DataFrame:
    """make(block id, texts, train flags, ids) -> arrays, for blocks of consecutive rows of each partition.

    A block is known by a digest of its texts; both passes over docs must cut
    the same blocks, which _score verifies.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            texts = t.column("text").to_pylist()
            digest = hashlib.blake2b(digest_size=16)
            for x in texts:
                body = (x or "").encode("utf-8", "surrogatepass")
                digest.update(len(body).to_bytes(8, "little") + body)
            yield from make(digest.digest(), texts, np.array(t.column("train").to_pylist(), dtype=bool), t.column("doc_id").to_pylist())

        size = 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for part in slices(lengths, BLOCK_CHARS):
                held.append(batch.slice(part.start, part.stop - part.start))
                size += sum(lengths[part])
                if size >= BLOCK_CHARS // 2:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _serve(key, table):
    """One shard: add up what all blocks counted, build the trie, answer each block."""
    names = ("words", "counts", "contexts", "totals", "runs", "next", "pairs")
    unpack = (_unpack, _whole, _unpack, _whole, _whole, _unpack6, _whole)
    col = {n: [f(x.as_buffer()) for x in table.column(n)] for n, f in zip(names, unpack, strict=True)}
    n_words = [len(x) for x in col["words"]]
    known, place = np.unique(np.concatenate(col["words"]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(col["counts"]), minlength=len(known)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n_words)])
    # Contexts of a block: its words, then its hot ones.
    both = [np.concatenate([w, h]) for w, h in zip(col["words"], col["contexts"], strict=True)]
    contexts, ctx_place = np.unique(np.concatenate(both), return_inverse=True)
    ctx_total = np.zeros(len(contexts), dtype=np.int64)
    ctx_total[np.searchsorted(contexts, known)] = total
    hot, hot_place = np.unique(np.concatenate(col["contexts"]), return_inverse=True)
    ctx_total[np.searchsorted(contexts, hot)] = np.bincount(hot_place, weights=np.concatenate(col["totals"]), minlength=len(hot)).astype(np.int64)
    parent = np.repeat(ctx_place, np.concatenate(col["runs"]))
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in col["next"]])])
    succ, count = np.concatenate(col["next"]), np.concatenate(col["pairs"])
    del col, both
    # Each distinct pair once, with the counts of all blocks added up.
    order = np.lexsort((succ, parent))
    p, s = parent[order], succ[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    c = np.add.reduceat(count[order], first) if len(first) else count
    of_pair = np.cumsum(new) - 1
    p, s = p[first], s[first]
    learned = c > 0
    with tempfile.TemporaryDirectory() as folder:
        held, runs = np.unique(p[learned], return_counts=True)
        trie = Trie(Path(folder), contexts[held], runs, s[learned], np.log10(c[learned] / (ctx_total[p[learned]] + MU)))
        codes = np.empty(len(order), dtype=np.uint8)
        codes[order] = trie.lookup(contexts[p], s)[of_pair]
        low, high = trie.low, trie.high
        del trie
    n_blocks, rest = len(n_words), [0] * (len(n_words) - 1)
    return pa.table(
        {
            "block": table.column("block").cast(pa.binary()),
            "shard": pa.array([key[0].as_py()] * n_blocks, pa.int32()),
            "counts": pa.array([total[place[at[i] : at[i + 1]]].view(np.uint8).reshape(-1, 8).T.tobytes() for i in range(n_blocks)], pa.binary()),
            "codes": pa.array([codes[cuts[i] : cuts[i + 1]].tobytes() for i in range(n_blocks)], pa.binary()),
            "low": pa.array([low] * n_blocks, pa.float64()),
            "high": pa.array([high] * n_blocks, pa.float64()),
            "n": pa.array([int(total.sum()), *rest], pa.int64()),
            "v": pa.array([int((total > 0).sum()), *rest], pa.int64()),
        }
    )


def _score(block: Block, answers: dict[int, tuple], shards: int, hot: dict[int, int], n: int, v: int) -> dict[str, np.ndarray]:
    """Scores of a block's documents from its answers."""
    count, seen = np.zeros(len(block.words), dtype=np.int64), np.zeros(len(block.first))
    for s, ws, _, ps, _ in block.parts(shards, hot):
        counts, codes, low, high = answers[s]
        count[ws] = np.ascontiguousarray(np.frombuffer(counts, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()
        seen[ps] = Trie.probabilities(np.frombuffer(codes, dtype=np.uint8), low, high)
    alone = (count + 0.5) / (n + 0.5 * (v + 1))
    context = count.astype(np.float64)
    context[block.words == BEGIN] = count[block.words == END].sum()  # as many beginnings as ends
    pair = seen + MU / (context[block.first] + MU) * alone[block.second]
    add = lambda values: np.bincount(block.doc, weights=values, minlength=block.n_docs)
    return {"n_tokens": block.sizes, "n_known": add(count[block.word] > 0).astype(np.int64), "base_score": add(np.log10(alone)[block.word]), "score": add(np.log10(pair)[block.pair])}


def _hot_contexts(docs: DataFrame, total: int, shards: int) -> dict[int, int]:
    """First words so frequent that one shard should not hold all of their pairs, and how many shards take them."""
    share = min(1.0, PLAN_BYTES / max(total, 1))
    part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else docs

    def run(batches):
        for batch in batches:
            b = Block(batch.column("text").to_pylist())
            counts = np.bincount(b.context, minlength=len(b.words))
            yield pa.RecordBatch.from_arrays([pa.array(b.words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    counts = part.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    all_ = counts.agg(F.sum("n")).first()[0] or 1
    rows = counts.filter(F.col("n") * (2 * shards) >= all_).collect()  # at most 2 * shards rows
    return {int(BEGIN): 1} | {int(np.int64(r.word).view(np.uint64)): min(shards, 1 + 2 * r.n * shards // all_) for r in rows}


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Base: words alone with 0.5 added to each count. Model: P(w | u) =
    c(uw) / (c(u) + MU) + MU / (c(u) + MU) * P(w), the first part from the
    trie. Null and empty texts hold the end token only. Repeated rows count
    each time. A null doc_id is learned from and not held out. docs must give
    the same rows in the same order when read again, as a table does.
    """
    base = docs.select("doc_id", "text", F.coalesce(learns(F.col("doc_id")), F.lit(True)).alias("train"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = _hot_contexts(docs.select("doc_id", "text"), total, shards) if shards > 1 else {int(BEGIN): 1}

    def ask(block_id, texts, train, ids):
        rows = [(s, block_id, *rest) for s, *rest in Block(texts).asks(train, shards, hot)]
        types = [pa.int32()] + [pa.binary()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in ASK.split(", ")])

    answers = cut_table(_blocks(base, ask, ASK).groupBy("shard").applyInArrow(_serve, ANSWER))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    id_type = docs.schema["doc_id"].dataType
    held = T.StructType().add("block", "binary").add("ids", T.ArrayType(id_type)).add("train", T.ArrayType(T.BooleanType())).add("sizes", T.ArrayType(T.IntegerType())).add("texts", "binary")

    def store(block_id, texts, train, ids):
        bodies = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))
        yield pa.RecordBatch.from_pydict({"block": pa.array([block_id], pa.binary()), "ids": [ids], "train": [train.tolist()], "sizes": pa.array([[len(b) for b in bodies]], pa.list_(pa.int32())), "texts": pa.array([packed], pa.binary())})

    out = T.StructType().add("doc_id", id_type).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    types = [to_arrow_type(f.dataType) for f in out]

    def finish(left, right):
        replies = {s: rest for s, *rest in zip(*(right.column(x).to_pylist() for x in ("shard", "counts", "codes", "low", "high")), strict=True)}
        made: list[list] = [[] for _ in types]
        for row in left.to_pylist():
            if not replies:
                raise RuntimeError("docs gave other blocks of rows when read again; write them to a table first")
            data, texts, at = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, sum(row["sizes"]))), [], 0
            for size in row["sizes"]:
                texts.append(data[at : at + size].decode("utf-8", "surrogatepass"))
                at += size
            got = _score(Block(texts), replies, shards, hot, n, v)
            columns = [row["ids"], [not t for t in row["train"]], got["n_tokens"], got["n_known"], [n] * len(texts), got["base_score"], got["score"]]
            for whole, part in zip(made, columns, strict=True):
                whole.extend(part)
        return pa.table([pa.array(m, t) for m, t in zip(made, types, strict=True)], names=out.fieldNames())

    left = _blocks(base, store, held).groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(finish, out)

