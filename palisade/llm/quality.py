"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import cut, filter_texts, map_texts
from palisade.llm.tokens import Words, mix64

#: Hashed features: byte 1- to 3-grams of the text as it is, words and word pairs of the lower-cased text.
BITS = 18
#: Further indicators: "at most k/8 of the word n-grams (n = 1 to 3) are distinct", and the offset as the last one.
N_FEATURES = (1 << BITS) + 3 * 8 + 1
#: The hinge-loss model is fitted on at most this many labelled rows, those of least hash; half of them per class where there are as many.
MAX_FIT = 3_000
#: Weight of a row's loss, passes of coordinate descent, and the share of the plain mean weight mixed in.
COST, PASSES, MEAN_SHARE = 1.0, 12, 0.1
#: Labels are broadcast up to this many rows (at most 32 MB), so that texts stay where they are; beyond, they are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Added to the counts of a feature in each class.
SMOOTH = 1.0


def learns(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text; the last one, present in every text, is the offset."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    size = 1 << BITS
    parts = [np.array([N_FEATURES - 1], dtype=np.int64)]
    if len(raw):
        parts.append(raw.astype(np.int64))
    if len(raw) > 1:
        parts.append((256 + (((raw[:-1] << 8) | raw[1:]) * np.uint32(2654435761) >> np.uint32(32 - BITS + 1))).astype(np.int64) % size)
    if len(raw) > 2:
        tri = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        parts.append(((tri * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int64))
    seen = np.zeros(N_FEATURES, dtype=bool)
    for p in parts:
        seen[p] = True
    w = Words([text])
    for n in (1, 2, 3):
        hashes, whole = w.windows(n)
        if n < 3:
            seen[(mix64(hashes[whole] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        if len(hashes):
            least = -(-8 * len(np.unique(hashes)) // len(hashes))  # eighths, rounded up
            seen[size + 8 * (n - 1) + least - 1 : size + 8 * n - 1] = True
    return np.flatnonzero(seen)


def _feature_lists():
    return lambda texts: {"f": [features(t).tolist() for t in texts]}


def class_counts(labelled: DataFrame) -> DataFrame:
    """(f, n0, n1): in how many labelled texts of each class a feature occurs; over all labelled rows.

    Each task adds up its own texts first and sends a row per feature.
    """
    import pyarrow as pa

    def run(batches):
        counts = np.zeros((2, N_FEATURES), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                counts[y, features(text)] += 1
        f = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(counts[0, f]), pa.array(counts[1, f])], names=["f", "n0", "n1"])

    return labelled.select("text", "y").mapInArrow(run, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised squared hinge loss over scaled indicators.

    Rows are scaled to unit length; each pass takes the rows in a seeded
    random order and moves one dual variable at a time.
    """
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    values = [scale[r] / max(np.linalg.norm(scale[r]), 1e-12) for r in rows]
    diagonal, rng = 1 / (2 * COST), np.random.default_rng(7)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i]) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / (1 + diagonal), 0.0)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


class Model:
    """Weights over scaled indicators; score() maps a text to 0..1, one half at the boundary."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, steep: float, constant: float | None = None):
        self.weights, self.scale, self.steep, self.constant = weights.astype(np.float32), scale.astype(np.float32), steep, constant

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        f = features(text)
        s = self.scale[f].astype(np.float64)
        margin = float(self.weights[f].astype(np.float64) @ s) / max(float(np.sqrt(s @ s)), 1e-12)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.steep * margin))))

    def parts(self) -> tuple:
        """The constructor's arguments: arrays and numbers, which a broadcast carries to workers without this package."""
        return self.weights, self.scale, self.steep, self.constant


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that may be learned from.

    Log-count ratios come from all of them, the hinge-loss model from a sample
    of at most MAX_FIT. Conflicting labels of a doc_id count for the least one;
    null labels and labels other than 0 and 1 are ignored. Without rows of both
    classes the score is the share of class 1 (0.5 if there are none).
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    marks = cut(marks.filter(learns(F.col("doc_id"))))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    known = docs.select("doc_id", "text").filter(learns(F.col("doc_id"))).join(marks, "doc_id")
    counts = class_counts(known)
    pair = np.zeros((2, N_FEATURES))
    for r in counts.collect():  # one row per feature, at most N_FEATURES
        pair[:, r.f] = r.n0, r.n1
    n = pair[:, -1]  # the offset occurs in every text
    if not n.min():
        return Model(np.zeros(1), np.zeros(1), 1.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    p = (pair + SMOOTH) / (pair + SMOOTH).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    ratio[-1] = np.abs(ratio).mean()  # the offset has no ratio of its own
    each = [int(min(n[c], max(MAX_FIT // 2, MAX_FIT - n[1 - c]))) for c in (0, 1)]
    sample = []
    for c in (0, 1):
        some = known.filter(F.col("y") == c)
        most = F.lit(min(1.0, 1.3 * each[c] / n[c] + 200 / n[c]))
        part = some.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < most * (1 << 20)) if n[c] > each[c] else some
        sample.append(part)
    made = map_texts(sample[0].unionByName(sample[1]).select("doc_id", "y", F.xxhash64("text").alias("tie"), "text"), _feature_lists, T.StructType().add("f", T.ArrayType(T.IntegerType())))
    drawn: dict[int, list] = {0: [], 1: []}
    for r in made.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id", "tie").toLocalIterator():
        if len(drawn[r.y]) < each[r.y]:
            drawn[r.y].append(np.array(r.f, dtype=np.int32))
    rows = drawn[0] + drawn[1]
    y = np.array([-1.0] * len(drawn[0]) + [1.0] * len(drawn[1]))
    w = fit_hinge(rows, y, ratio)
    w = (1 - MEAN_SHARE) * w + MEAN_SHARE * np.abs(w).mean()
    return Model(w, ratio, 6.0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id, held_out, score, predicted.

    Only the text enters a score; null and empty texts have the offset alone.
    Repeated rows get equal scores; an empty labels table gives 0.5. A null
    doc_id is never learned from and is not held out. Other columns of docs
    and labels are neither read nor returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).parts())

    def setup():
        model = Model(*sent.value)
        return lambda texts: {"score": [model.score(t) for t in texts]}

    made = map_texts(docs.select("doc_id", "text"), setup, T.StructType().add("score", "double"))
    held = F.coalesce(~learns(F.col("doc_id")), F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts (score >= 0.5); columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).parts())

    def setup():
        model = Model(*sent.value)
        return lambda texts: [model.score(t) >= 0.5 for t in texts]

    return filter_texts(docs, setup)
