"""Shared column expressions and session helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space that separates tokens: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that identify a text; null counts as empty.

    Rows are keyed by content rather than by doc_id, so that null or repeated
    identifiers neither lose nor multiply rows.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share; a local one only where Spark itself runs on one machine."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(path or f"file:///tmp/spark-checkpoints-{uuid.uuid4().hex[:8]}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it from there on."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside `__row`, a struct of all columns: working columns then can't clash with docs'."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), *names)


def unpacked(docs: DataFrame, replaced: dict[str, Column] | None = None) -> list[Column]:
    """docs' columns out of `__row`, some of them replaced."""
    replaced = replaced or {}
    return [replaced[c].cast(docs.schema[c].dataType).alias(c) if c in replaced else F.col("__row").getField(c).alias(c) for c in docs.columns]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_texts(docs: DataFrame, setup, fields: T.StructType, text: str = "text", most: int = 2_000_000, keep: list[str] | None = None) -> DataFrame:
    """docs without `text`, plus the columns that a function makes of batches of texts.

    setup() runs once per task and returns a function: list of texts (None for
    null) -> dict of lists. A batch holds `most` characters, or one text. Other
    columns pass through Arrow untouched; those named like a new one give way.
    """
    new = fields.fieldNames()
    others = [c for c in (docs.columns if keep is None else keep) if c != text and c not in new]
    schema = T.StructType([docs.schema[c] for c in others] + fields.fields)
    types = [to_arrow_type(f.dataType) for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            texts = batch.column(text)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for part in slices(sizes, most):
                made = work(texts.slice(part.start, part.stop - part.start).to_pylist())
                passed = [batch.column(c).slice(part.start, part.stop - part.start) for c in others]
                yield pa.RecordBatch.from_arrays(passed + [pa.array(made[n], t) for n, t in zip(new, types, strict=True)], names=others + new)

    return docs.select(*others, text).mapInArrow(run, schema)


def filter_texts(docs: DataFrame, setup, text: str = "text", most: int = 2_000_000) -> DataFrame:
    """The rows of docs for whose texts the function of setup() gives true; columns untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            texts = batch.column(text)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            keep = [k for part in slices(sizes, most) for k in work(texts.slice(part.start, part.stop - part.start).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items whose sizes add up to `most` at most, or of one item."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def crc32_sql(text: str) -> str:
    """DuckDB expression: crc32 of an ASCII text, with crc_table() in reach as `crc`."""
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c >> 8, crc.t[((xor(c, b) & 255) + 1)::int])))"


#: A one-row table of the polynomial's remainders, made from its rule.
CRC_TABLE_SQL = "crc as (select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end) order by n) as t from range(256) r(n))"
