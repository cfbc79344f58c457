"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import map_texts

#: Bytes of raw content per language, and for all languages together (a bound on what is broadcast).
DICT_BYTES, ALL_BYTES = 96 << 10, 64 << 20
#: Texts per language that content is drawn from, and characters taken of each (content only; texts are identified whole).
DRAWN, EXCERPT = 160, 1_200
LEVEL = 6
#: A decision is marked as rejected when the runner-up is within this share of its size.
MARGIN = 0.01
#: Score: logistic function of this times the relative margin, which maps no margin to one half.
STEEP = 40.0

UNKNOWN = "und"


def learns(doc_id: Column) -> Column:
    """Rows whose languages may be learned from."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def plain(text: str) -> bytes:
    """Lower-cased letters, everything else as single spaces."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    return " ".join(kept.split()).encode()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary per language, from documents that may be learned from.

    The sample is the documents of least hash; it is bounded per language, so
    the result has a bounded size. Null languages and blank texts are skipped.
    """
    known = docs.select("doc_id", "lang", "text").filter(learns(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = {lang: min(1.0, 2.0 * DRAWN / n + 20.0 / n) for lang, n in sizes.items()}
    wanted = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(s)) for lang, s in share.items()])
    place = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 30))
    drawn = known.withColumn("_at", place).filter(F.col("_at") < wanted * (1 << 30))
    begin = (F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1).cast("int")
    rows = drawn.select("lang", "_at", F.substring("text", begin, F.lit(EXCERPT)).alias("part")).orderBy("lang", "_at", "part")
    limit = min(DICT_BYTES, ALL_BYTES // len(sizes))
    out: dict[str, bytearray] = {lang: bytearray() for lang in sizes}
    for r in rows.toLocalIterator():
        if len(out[r.lang]) < limit:
            out[r.lang] += plain(r.part) + b" "
    order = sorted((lang for lang in out if out[lang]), key=lambda lang: (-sizes[lang], lang))
    return {lang: bytes(out[lang][:limit]) for lang in order}


class Identifier:
    """Compresses a text with each language's dictionary; the smallest result wins."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.coders = []
        for content in contents.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). Ties go to the language with more learned documents."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        body = plain(text)
        sizes = sorted((len(c.compress(body)), i) for i, c in enumerate(self.coders))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return self.langs[sizes[0][1]], 1 / (1 + math.exp(-STEEP * margin)), margin < MARGIN


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs.

    Null texts and texts without a letter are `und` with score 0, as is every
    text if nothing could be learned. `rejected` marks narrow margins; lang_pred
    then still names the closest language. A null doc_id is not learned from
    and not held out. Other columns are neither read nor returned.
    """
    contents = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def setup():
        model = Identifier(contents.value)

        def work(texts: list) -> dict[str, list]:
            lang, score, rejected = zip(*map(model.identify, texts), strict=True)
            return {"lang_pred": lang, "score": score, "rejected": rejected}

        return work

    fields = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    made = map_texts(docs.select("doc_id", "text"), setup, fields)
    return made.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
