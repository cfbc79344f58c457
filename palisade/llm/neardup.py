"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each text becomes a set of five-word shingles. Texts with equal sets form
   one node (exact copies collapse before anything is joined).
2. MinHash values are banded; a bucket holds the nodes that share a band. In
   each bucket, pairs are compared MinHash by MinHash and dropped when the
   posterior probability of reaching the threshold falls below a tolerance.
   A bucket returns a star for each set of nodes that what remains connects;
   pairs that are connected already are not compared. Buckets beyond a bound
   are split into chunks, and each pair of chunks is compared on its own.
3. Components of the stars are clusters: every pair that passed lies inside
   one of them. A cluster is split into chunks of bounded size and each pair of
   chunks goes to one task. There, the pairs that share a band are compared
   again and those that pass are verified exactly on the shingle sets.
4. A task returns, per node, its number of links and its component within the
   chunk pair - never the pairs. Components of those stars are the groups.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import cut, map_texts, packed, text_key, unpacked
from palisade.llm.tokens import Words

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8^6)^44 = 1.6e-6.
BANDS, ROWS = 44, 6
#: A pair is dropped when its posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-9
#: MinHash values compared before each look at the posterior.
STEP = 24
#: Bounds of a chunk; clusters and buckets beyond them are split into more chunks, never cut short.
CHUNK_SHINGLES, CHUNK_NODES, CHUNK_BUCKET = 600_000, 1_500, 2_000
#: Rows of buckets that one task compares.
TASK_ROWS = 10_000

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of all its words if they are fewer than five."""
    w, out = Words(texts), []
    hashes, _ = w.windows(SHINGLE)
    for a, b in zip(w.first, w.last, strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(hashes[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(Words([w.text(a, b - a).decode("utf-8", "surrogatepass")]).windows(int(b - a))[0])
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit MinHash value per hash function; bounded memory for any text length."""
    out = np.full(len(_ODD), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(shingles), 2048):
        part = (shingles[i : i + 2048, None] ^ _XOR) * _ODD
        np.minimum(out, (part >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def _bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _signature(values: np.ndarray) -> bytes:
    """The low byte of each MinHash value: equal values have equal bytes, others 1 in 256."""
    return values.astype(np.uint8).tobytes()


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n MinHash values at which P(similarity >= threshold) reaches the tolerance.

    With a uniform prior the posterior is a Beta distribution, whose upper tail
    equals P(Binomial(n + 1, threshold) <= matches).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


#: Fewest matches after each step. A plain table: a cached function would reach workers by its name only.
LEAST = {n: least_matches(n) for n in (min(i + STEP, BANDS * ROWS) for i in range(0, BANDS * ROWS, STEP))}


def _signatures():
    def work(texts: list) -> dict[str, list]:
        made: dict[str, list] = {"node": [], "n_shingles": [], "bands": [], "signature": []}
        for s in shingle_sets(texts):
            values = minhashes(s) if len(s) else None
            made["n_shingles"].append(len(s))
            made["node"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            made["bands"].append(_bands(values).view(np.int64).tolist() if len(s) else None)
            made["signature"].append(_signature(values) if len(s) else None)
        return made

    return work


def _passing(a: int, near: np.ndarray, signatures: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Those of `near` that may reach the threshold with a, by their sizes and then by MinHash values, a step at a time.

    Chance matches of bytes only let more pairs pass.
    """
    near = near[np.minimum(size[near], size[a]) >= THRESHOLD * np.maximum(size[near], size[a]) - 1e-9]
    met = np.zeros(len(near), dtype=np.int64)
    for i in range(0, signatures.shape[1], STEP):
        if not len(near):
            break
        met += (signatures[near, i : i + STEP] == signatures[a, i : i + STEP]).sum(axis=1)
        alive = met >= LEAST[min(i + STEP, signatures.shape[1])]
        near, met = near[alive], met[alive]
    return near


def _stars(left: np.ndarray, right: np.ndarray, same: bool, signatures: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of the nodes that passing pairs of left x right connect; the nodes' numbers are below len(size)."""
    label = np.arange(len(size))
    for k, a in enumerate(left):
        others = right[k + 1 :] if same else right
        met = _passing(int(a), others[label[others] != label[a]], signatures, size)
        if len(met):
            joined = np.unique(np.append(label[met], label[a]))
            label[np.isin(label, joined)] = joined[0]
    return [(i, int(label[i])) for i in np.flatnonzero(label != np.arange(len(size)))]


def _compare_buckets(table: pa.Table) -> pa.Table:
    """Stars (a, b) of all buckets, or pairs of chunks of buckets, in a table of (band, i, j, chunk, node, signature, n_shingles)."""
    key = [table.column(c).to_numpy() for c in ("j", "i", "band")]
    order = np.lexsort(key)
    nodes = table.column("node").to_pylist()
    every = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(len(nodes), -1)
    sizes, chunk = table.column("n_shingles").to_numpy(), table.column("chunk").to_numpy()
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    begin = np.append(np.flatnonzero(new), len(order))
    out: set[tuple[bytes, bytes]] = set()
    for x, y in zip(begin[:-1], begin[1:], strict=True):
        rows = order[x:y]
        i, j = key[1][rows[0]], key[0][rows[0]]
        left, right = np.flatnonzero(chunk[rows] == i), np.flatnonzero(chunk[rows] == j)
        out.update((nodes[rows[a]], nodes[rows[b]]) for a, b in _stars(left, right, i == j, every[rows], sizes[rows]))
    stars = sorted(out)
    return pa.table({"a": pa.array([s[0] for s in stars], pa.binary()), "b": pa.array([s[1] for s in stars], pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in the edges (a, b): label is the least node of its component.

    Each round hooks every node to its least neighbour, shortens the hooks by
    two jumps, and contracts the edges to the hooked nodes, so that dense
    groups shrink to a few edges after one round. Everything stays distributed
    and is checkpointed each round.
    """
    every = cut(edges.select("a", "b").distinct())
    labels = every.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    left = every.filter("a <> b")
    while True:
        ways = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hooks = cut(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to")))
        if hooks.isEmpty():
            return labels
        for _ in range(2):
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("far"))
            hooks = hooks.join(further, "to").select("from", F.col("far").alias("to"))
        hooks = cut(hooks)
        labels = cut(labels.join(hooks, labels.label == hooks["from"], "left").select("node", F.coalesce("to", "label").alias("label")))
        at_a, at_b = hooks.select(F.col("from").alias("a"), F.col("to").alias("a2")), hooks.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        moved = left.join(at_a, "a").join(at_b, "b").filter("a2 <> b2")
        left = cut(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())


def _chunked(rows: DataFrame) -> DataFrame:
    """rows(node, c, ...) with `chunk`, once for each pair of chunks (i, j) that the row takes part in."""
    placed = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    return placed.select("*", F.inline(pairs)).drop("c")


def _candidate_clusters(nodes: DataFrame) -> DataFrame:
    """(node, label): nodes of pairs that share a band and pass the comparison, and their cluster."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    held = rows.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    # Near copies share many bands: of buckets that hold the same nodes one is enough.
    shared = held.filter("n > 1").groupBy("n", "x", "lo", "hi").agg(F.min("band").alias("band")).select("band", "n")
    buckets = cut(rows.join(shared, "band").select("band", "node", F.ceil(F.col("n") / CHUNK_BUCKET).cast("int").alias("c")))
    tasks = 1 + (buckets.agg(F.sum("c")).first()[0] or 0) // TASK_ROWS
    dealt = _chunked(buckets.join(nodes.select("node", "signature", "n_shingles"), "node"))
    task = F.pmod(F.xxhash64("band", "i", "j"), F.lit(tasks)).alias("task")
    return components(dealt.groupBy(task).applyInArrow(_compare_buckets, "a binary, b binary"))


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, others) -> None:
        for b in others:
            ra, rb = self.root(a), self.root(b)
            self.up[max(ra, rb)] = min(ra, rb)


def _links(sets: list[np.ndarray], signatures: np.ndarray, bands: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, list[int], int]:
    """Links per node among left x right (each pair once if they are the same chunk), a forest of them, and the number of pairs compared."""
    n, width = bands.shape
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(size)])
    member = np.zeros(ids.max() + 1, dtype=bool)
    # Nodes by band: `holders[start[g] : start[g + 1]]` share band g.
    group = np.unique(bands.ravel(), return_inverse=True)[1].reshape(n, width)
    holders = np.argsort(group.ravel(), kind="stable") // width
    start = np.concatenate([[0], np.cumsum(np.bincount(group.ravel()))])
    wanted = np.zeros(n, dtype=bool)
    wanted[right] = True
    count, forest, compared = np.zeros(n, dtype=np.int64), _Forest(n), 0
    for k, a in enumerate(left):
        if same:
            wanted[a] = False
        near = right[k + 1 :] if same else right
        if (start[group[a] + 1] - start[group[a]]).sum() < len(near):
            near = np.unique(np.concatenate([holders[start[g] : start[g + 1]] for g in group[a]]))
            near = near[wanted[near]]
        else:
            near = near[(bands[near] == bands[a]).any(axis=1)]
        compared += len(near)
        near = _passing(int(a), near, signatures, size)
        if not len(near):
            continue
        member[ids[begin[a] : begin[a + 1]]] = True
        both = np.array([np.count_nonzero(member[ids[begin[b] : begin[b + 1]]]) for b in near])
        member[ids[begin[a] : begin[a + 1]]] = False
        true = near[both >= THRESHOLD * (size[a] + size[near] - both) - 1e-9]
        count[a] += len(true)
        count[true] += 1
        forest.join(int(a), true.tolist())
    return count, [forest.root(i) for i in range(n)], compared


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of chunks of one cluster: links of each node, and the least node it is linked with here."""
    pdf = pdf.sort_values("node", ignore_index=True)
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
    signatures = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint8).reshape(len(pdf), -1)
    chunk = pdf["chunk"].to_numpy()
    count, root, _ = _links(sets, signatures, np.stack(pdf["bands"].to_list()), np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), i == j)
    return pd.DataFrame({"node": pdf["node"], "links": count, "root": pdf["node"].iloc[root].to_numpy()})


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of each row of docs, classes of nodes).

    Features: doc_id, k1, k2, node. Classes: node, copy (its least row), rep
    (the class's least row), n_links; rows order by doc_id, null last, then text.
    """
    k1, k2 = text_key(F.col("text"))
    fields = T.StructType().add("node", "binary").add("n_shingles", "integer").add("bands", T.ArrayType(T.LongType())).add("signature", "binary")
    feats = cut(map_texts(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text"), _signatures, fields))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    nodes = feats.filter("node is not null").groupBy("node").agg(F.min(row).alias("copy"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = cut(nodes)
    clusters = _candidate_clusters(nodes)
    members = cut(clusters.join(nodes, "node"))
    size = members.groupBy("label").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    chunks = size.select("label", F.greatest(F.ceil(F.col("s") / CHUNK_SHINGLES), F.ceil(F.col("n") / CHUNK_NODES)).cast("int").alias("c"))
    # One text per node, then one copy of its set for each pair of chunks it takes part in.
    own = ["node", "label", "c", "bands", "signature"]
    wanted = members.join(chunks, "label").select(*own, F.col("copy.doc_id").alias("_id"), F.col("copy.k1").alias("_k1"), F.col("copy.k2").alias("_k2"))
    with_text = _rows_of(docs.select("doc_id", "text"), wanted).select(*own, "text")
    sets = map_texts(with_text, lambda: lambda t: {"shingles": [s.tobytes() for s in shingle_sets(t)]}, T.StructType().add("shingles", "binary"))
    found = cut(_chunked(sets).groupBy("label", "i", "j").applyInPandas(_compare, "node binary, links long, root binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copy").join(groups, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named.select("node", "label", "copy", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    least = named.groupBy("label").agg(F.min("copy").alias("rep"))
    return feats.select("doc_id", "k1", "k2", "node"), cut(named.join(least, "label").select("node", "copy", "rep", "n_links"))


def _rows_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs joined with rows on (_id, _k1, _k2); repeated rows of docs come once."""
    k1, k2 = text_key(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (k1 == F.col("_k1")) & (k2 == F.col("_k2"))
    return packed(docs, "doc_id", "text").join(rows, same).dropDuplicates(["_id", "_k1", "_k2"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_id, n_links for each row of docs.

    copy_id is the least doc_id with the same shingle set; class_id the least
    doc_id connected by links of Jaccard >= 0.8; n_links the number of other
    distinct shingle sets within 0.8. Texts without words (null, empty) match
    nothing: each is a class of its own. Rows with a null doc_id take part; a
    class of such rows only has a null class_id.
    """
    feats, classes = classify(docs)
    own = F.when(F.col("node").isNull(), F.col("doc_id"))
    return feats.join(classes, "node", "left").select(
        "doc_id", F.coalesce("rep.doc_id", own).alias("class_id"), F.coalesce("copy.doc_id", own).alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: its least doc_id; columns unchanged.

    Texts without words all stay; of rows that repeat the kept document one stays.
    """
    _, classes = classify(docs)
    reps = classes.select(F.col("rep.doc_id").alias("_id"), F.col("rep.k1").alias("_k1"), F.col("rep.k2").alias("_k2")).distinct()
    blank = docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False)))
    return _rows_of(docs, reps).select(*unpacked(docs)).unionByName(blank)
