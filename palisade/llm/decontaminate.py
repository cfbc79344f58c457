"""Benchmark decontamination: windows of benchmark words looked up in training texts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import ascii_lower, cut, filter_texts, map_texts, packed, text_key, unpacked
from palisade.llm.tokens import Words

WINDOW = 13
#: A document is contaminated when hits are at least 1 / SHARE of its words.
SHARE = 20
#: The set of windows is broadcast up to this many, and up to so many bytes of words; beyond, bits are, and hits are joined by shuffle. The rows are the same.
MAX_BROADCAST, MAX_BYTES = 1_000_000, 64 << 20
#: Bits of the broadcast filter that replaces the set beyond that (64 MB), whatever the size of the benchmark.
FILTER_BITS = 29


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, n, hash, words) of every item; items without words or text have none."""

    def setup():
        def work(texts: list) -> dict[str, list]:
            made = []
            for text in texts:
                w = Words([text])
                n = min(window, len(w.hash))
                hashes = w.windows(n)[0].view(np.int64) if n else []
                made.append([{"n": n, "hash": int(h), "words": w.text(i, n)} for i, h in enumerate(hashes)])
            return {"w": made}

        return work

    each = T.StructType().add("n", "integer").add("hash", "long").add("words", "binary")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    made = map_texts(items, setup, T.StructType().add("w", T.ArrayType(each)))
    return made.select("item_id", F.inline("w")).distinct()


def _marks(spans: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words covered by spans of n words that begin at the given words."""
    step = np.zeros(total + 1, dtype=np.int32)
    np.add.at(step, spans, 1)
    np.add.at(step, spans + n, -1)
    return np.cumsum(step[:-1]) > 0


class _Set:
    """Exact windows of one word count, with a bit filter in front of a sorted array."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        self.items: dict[tuple[int, bytes], list[str]] = {}
        for item, h, words in rows:
            self.items.setdefault((h, words), []).append(item)
        self.keys = np.unique(np.array([h for _, h, _ in rows], dtype=np.int64).view(np.uint64))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)] & whole)
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        return near[self.keys[at] == hashes[near]]


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(windows: dict[int, list[tuple[str, int, bytes]]]):
    """Set up a function that finds and verifies the hits of a batch of texts."""
    sets = {n: _Set(rows) for n, rows in windows.items()}

    def work(texts: list) -> dict[str, list]:
        w, found, made = Words(texts), [], {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": []}
        for n, known in sets.items():
            hashes, whole = w.windows(n)
            at = known.find(hashes, whole)
            if len(at):
                found.append((n, at, hashes.view(np.int64)))
        for a, b in zip(w.first, w.last, strict=True):
            items, marked = set(), np.zeros(b - a, dtype=bool)
            for n, at, signed in found:
                true = []
                for i in at[np.searchsorted(at, a) : np.searchsorted(at, b)]:
                    if got := sets[n].items.get((int(signed[i]), w.text(i, n))):
                        items.update(got)
                        true.append(i - a)
                if true:
                    marked |= _marks(np.array(true), n, b - a)
            for name, value in zip(made, (int(b - a), int(marked.sum()), len(items), _digest(items)), strict=True):
                made[name].append(value)
        return made

    return work


RESULT = T.StructType().add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string")


def _small(windows: DataFrame, max_broadcast: int):
    """The windows as a broadcast variable, or None if they are too many or too large; both are measured first."""
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item_id") + 60), F.lit(0))).first()
    if n > max_broadcast or size > MAX_BYTES:
        return None
    by_n: dict[int, list] = {}
    for r in windows.collect():
        by_n.setdefault(r.n, []).append((r.item_id, r.hash, bytes(r.words)))
    return windows.sparkSession.sparkContext.broadcast(by_n)


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without text, plus n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 13 consecutive words of an item, or all words of a shorter
    one. Null and empty texts have no words and no hits; repeated rows each
    get their result; an empty benchmark hits nothing. Columns of docs named
    like a new one give way, all others stay.
    """
    docs = docs.drop("contaminated")
    windows = cut(benchmark_windows(benchmark))
    sent = _small(windows, max_broadcast)
    out = _by_shuffle(docs, windows) if sent is None else map_texts(docs, lambda: _scan(sent.value), RESULT)
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))
    return out.withColumn("contaminated", dirty)


def _by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same result when the benchmark is too large to broadcast.

    A bit filter of fixed size goes to the tasks; windows that pass it are
    joined with the benchmark's by hash and words, and hits are added up per
    document.
    """
    sizes = [r[0] for r in windows.select("n").distinct().collect()]  # 1 to 13
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    held = windows.select(top.alias("at")).groupBy((F.col("at") / 8).cast("long").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bit"))
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in held.toLocalIterator():
        bits[r.byte] = r.bit
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    k1, k2 = text_key(F.col("text"))
    keyed = packed(docs, "text").withColumns({"_k1": k1, "_k2": k2})
    texts = keyed.select("_k1", "_k2", "text")
    each = T.StructType().add("first", "integer").add("n", "integer").add("hash", "long").add("words", "binary")

    def setup():
        table = sent.value

        def work(texts_: list) -> dict[str, list]:
            w, made = Words(texts_), [[] for _ in texts_]
            for n in sizes:
                hashes, whole = w.windows(n)
                at = hashes >> np.uint64(64 - FILTER_BITS)
                bit = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                near = np.flatnonzero(whole & bit.astype(bool))
                doc, signed = np.searchsorted(w.last, near, side="right"), hashes.view(np.int64)
                for i, d in zip(near, doc, strict=True):
                    made[d].append({"first": int(i - w.first[d]), "n": n, "hash": int(signed[i]), "words": w.text(i, n)})
            return {"hits": made}

        return work

    made = map_texts(texts, setup, T.StructType().add("hits", T.ArrayType(each)))
    found = made.select("_k1", "_k2", F.inline("hits")).distinct()
    hits = cut(found.join(windows, ["n", "hash", "words"]).select("_k1", "_k2", "first", "n", "item_id"))
    spans = hits.select("_k1", "_k2", "first", (F.col("first") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("_k1", "_k2").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max("end").over(before), F.lit(0)), F.col("first"))
    hit = spans.withColumn("_new", F.greatest(F.col("end") - reach, F.lit(0))).groupBy("_k1", "_k2").agg(F.sum("_new").alias("n_hit"))
    items = hits.select("_k1", "_k2", "item_id").distinct().groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("item_id")).alias("_items"))
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    n_words = F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(alnum)), F.lit(0)).cast("long")
    out = keyed.join(hit, ["_k1", "_k2"], "left").join(items, ["_k1", "_k2"], "left")
    held = F.coalesce("_items", F.array().cast("array<string>"))
    made = {"n_words": n_words, "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_items": F.size(held).cast("long"), "items_sha256": F.sha2(F.array_join(held, ","), 256)}
    return out.select(*unpacked(docs.drop("text", *made)), *[c.alias(name) for name, c in made.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without contaminated documents; kept rows and columns are unchanged."""
    windows = cut(benchmark_windows(benchmark))
    sent = _small(windows, max_broadcast)
    if sent is None:
        k1, k2 = text_key(F.col("text"))
        marked = docs.select("text", k1.alias("_c1"), k2.alias("_c2"))
        dirty = find_contamination(marked, benchmark, max_broadcast).filter("contaminated").select("_c1", "_c2").distinct()
        return packed(docs, "text").join(dirty, (k1 == F.col("_c1")) & (k2 == F.col("_c2")), "left_anti").select(*unpacked(docs))

    def setup():
        scan = _scan(sent.value)

        def clean(texts: list) -> list[bool]:
            got = scan(texts)
            return [not (h and h * SHARE >= n) for h, n in zip(got["n_hit"], got["n_words"], strict=True)]

        return clean

    return filter_texts(docs, setup)


_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_SQL = f"""
with d as materialized (select doc_id, {_BENCH_WORDS} as w from documents),
b as (select item_id::varchar as item_id, {_BENCH_WORDS} as w from benchmark),
bw as materialized (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns)),
h as materialized (select doc_id, item_id, i, dw.n from dw join bw on dw.n = bw.n and dw.g = bw.g),
p as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(i, i + n)) as q from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""
