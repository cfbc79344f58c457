"""Token counts by a two-tier lookup on the map side.

A sentencepiece BPE model whose pieces hold the space sign at their beginning
only never joins characters across a word's beginning. Nor does it join a line
break that no piece holds. So a text's tokens are those of its pre-tokens, and
few distinct pre-tokens make up most of a corpus. Their lengths go to all
tasks as one compact table; a pre-token outside it is encoded once per Python
worker and kept in a bounded cache. No pre-token is ever shuffled: what tasks
exchange to build the table is at most LISTED rows each.
"""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from palisade.llm.spans import map_texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LIMIT = 4096
#: Entries of the broadcast table, and of what each task offers for it. Code points of an entry.
TABLE, LISTED, LONGEST = 1 << 16, 1 << 14, 48
#: Pre-tokens that a worker remembers beyond the table.
REMEMBERED = 1 << 19
#: Longer texts are read match by match instead of as a list of pre-tokens.
LONG = 1 << 20

PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


def model_bytes(path: str | None = None) -> bytes:
    """The model's bytes, after a check that its pre-tokens are independent of each other."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        raw = f.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    n, t = model.normalizer_spec, model.trainer_spec
    plain = [p.piece for p in model.pieces if p.type == p.NORMAL]
    apart = all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in plain) and not any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces)
    same = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and t.byte_fallback and not t.treat_whitespace_as_suffix
    if not (apart and same and t.model_type == t.BPE):
        raise ValueError("this model's tokens may cross words: count_tokens would not be exact")
    return raw


def pretokens(text: str) -> list[str] | Iterator[str]:
    """A text's pre-tokens without their first space sign; those that begin with a line break had none.

    The model puts one space sign before a text; an empty text has no tokens.
    """
    if not text:
        return []
    if len(text) <= LONG and text[0] != " " and "  " not in text and SPACE not in text:
        return text.replace("\n", " \n").split(" ")
    whole = SPACE + text.replace(" ", SPACE)
    return (m[0] if m[0][0] == "\n" else m[0][1:] for m in PRETOKEN.finditer(whole))


class Lengths(dict):
    """Pre-token -> number of tokens: the table's entries, then what this worker has met."""

    def __init__(self, frequent: dict[str, int], raw: bytes):
        super().__init__(frequent)
        self.frequent, self.model = frequent, sentencepiece.SentencePieceProcessor(model_proto=raw)

    def __missing__(self, key: str) -> int:
        # The model puts a space sign before what it encodes; before a line break that sign is a token of its own.
        n = len(self.model.encode(key)) - (key[:1] == "\n") if key else 1
        if len(key) <= LONGEST:
            self[key] = n
        return n

    def bound(self) -> None:
        if len(self) > len(self.frequent) + REMEMBERED:
            self.clear()
            self.update(self.frequent)


def frequent_pretokens(docs: DataFrame, text: str = "text", most: int = TABLE) -> list[str]:
    """The corpus's most frequent pre-tokens, at most `most`.

    Each task counts the pre-tokens of all its texts, forgetting the rarest
    when it holds too many, and offers LISTED of them; the offers are summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                met.update(pretokens(t.as_py() or ""))
                if len(met) > 16 * LISTED:
                    met = Counter(dict(met.most_common(8 * LISTED)))
        best = [x for x in met.most_common(LISTED) if len(x[0]) <= LONGEST]
        yield pa.RecordBatch.from_pydict({"token": pa.array([x[0] for x in best], pa.string()), "n": pa.array([x[1] for x in best], pa.int64())})

    offers = docs.select(text).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r.token for r in offers.orderBy(F.col("n").desc(), "token").limit(most).select("token").collect()]


def _packed(tokens: list[str], raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """One string of all tokens, where each ends, and their lengths."""
    lengths, known = Lengths({}, raw), []
    for t in tokens:
        known.append(lengths[t])
    return "".join(tokens).encode(), np.cumsum([len(t) for t in tokens], dtype=np.uint32), np.array(known, dtype=np.uint8)


def _unpacked(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    joined, ends = table[0].decode(), table[1].tolist()
    return {joined[a:b]: n for a, b, n in zip([0, *ends], ends, table[2].tolist(), strict=False)}


COUNTED = T.StructType([T.StructField("n_tokens", T.LongType())])


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without `text`, plus n_bytes, n_tokens and over_limit.

    Null and empty texts have no bytes and no tokens. Repeated rows stay.
    Columns of docs that are called like a new one give way. The table is only
    a cache: which pre-tokens it holds changes no count.
    """
    spark: SparkSession = docs.sparkSession
    raw = model_bytes(model)
    table = spark.sparkContext.broadcast((_packed(frequent_pretokens(docs, text), raw), raw))
    name = f"palisade_lengths_{hash(raw) & 0xFFFFFFFF:x}_{table.id if hasattr(table, 'id') else table._jbroadcast.id()}"

    def setup():
        # One cache for all tasks that this Python process runs.
        shared = sys.modules.setdefault("palisade_worker_caches", types.ModuleType("palisade_worker_caches"))
        if name not in vars(shared):
            vars(shared).clear()
            setattr(shared, name, Lengths(_unpacked(table.value[0]), table.value[1]))
        known = getattr(shared, name)

        def work(texts: list) -> dict[str, list]:
            out = [sum(map(known.__getitem__, pretokens(t or ""))) for t in texts]
            known.bound()
            return {"n_tokens": out}

        return work

    sized = docs.withColumn("n_bytes", F.octet_length(F.coalesce(docs[text], F.lit(""))).cast("long"))
    return map_texts(sized, setup, COUNTED, text).withColumn("over_limit", F.col("n_tokens") > limit)


def token_summary(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
