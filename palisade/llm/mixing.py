"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.spans import WORD, cut, packed, unpacked

#: Sources in code-point order (null last) take these weights in turn.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words: SHARE[0] / SHARE[1].
SHARE = (3, 2)
#: No source and no document is repeated beyond this rate.
MOST = 2
SEED = "mix-1"
#: The per-source table is broadcast up to this many bytes of names, and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20


def n_words(text: Column) -> Column:
    """Tokens between white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows in tasks by ranges of an order, with `_at`, ascending along it, and `_task`."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_at", 33))


def _running(rows: DataFrame, *sums: str) -> DataFrame:
    """rows of _dealt() plus `before_<column>`: the sum over all rows before.

    A task's rows are summed in that task; across tasks there is one row each.
    """
    parts = rows.groupBy("_task").agg(*[F.sum(c).alias(f"_p{c}") for c in sums])
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_task", *[F.coalesce(F.sum(f"_p{c}").over(earlier), F.lit(0)).alias(f"_s{c}") for c in sums])
    inside = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i{c}") for c in sums])
    return local.join(starts, "_task").select(*rows.columns, *[(F.col(f"_s{c}") + F.col(f"_i{c}")).alias(f"before_{c}") for c in sums])


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target): one row per source.

    Water filling: a source that its weighted share would repeat more than
    MOST times stops there and the rest is shared again by weight. In order of
    MOST * size / weight the stopped sources come first, so running sums find
    them. Sums are whole numbers and each target is one division. No task has
    to hold all sources.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size")).withColumn("_null", F.col(source).isNull())
    place = _running(_dealt(per, "_null", source).withColumn("one", F.lit(1)), "one")
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("before_one") % len(WEIGHTS) + 1).cast("int"))
    per = place.select(source, "source_size", "_null", turn.alias("w"))
    per = per.withColumn("_ratio", F.lit(float(MOST)) * F.col("source_size") / F.col("w"))
    per = _running(_dealt(per, "_ratio", "_null", source), "source_size", "w")
    every = per.agg(F.sum("source_size").alias("_all"), F.sum("w").alias("_weights"))
    per = per.crossJoin(F.broadcast(every))
    open_ = F.col("_weights") - F.col("before_w")
    rest = F.lit(SHARE[0]) * F.col("_all") - F.lit(SHARE[1]) * MOST * F.col("before_source_size")  # times SHARE[1]
    # A source stops if MOST * size <= its share of what those before it left.
    stops = F.lit(MOST * SHARE[1]) * F.col("source_size") * open_ <= rest * F.col("w")
    per = cut(per.select(source, "source_size", "w", "_at", stops.alias("_stops"), rest.alias("_rest"), open_.alias("_open")))
    first = per.filter("not _stops").agg(F.min(F.struct("_at", F.col("_rest").alias("rest"), F.col("_open").alias("open"))).alias("_first"))
    per = per.crossJoin(F.broadcast(first))
    shared = (F.col("_first.rest") * F.col("w")).cast("double") / (F.col("_first.open") * SHARE[1]).cast("double")
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first._at")), (F.col("source_size") * MOST).cast("double")).otherwise(shared)
    return per.select(source, "source_size", target.alias("target"))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) from the seed and the parts; the same on every run and every engine."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


NEW = ("size", "source_size", "target", "rate", "copies")


def _decided(docs: DataFrame) -> DataFrame:
    """`__row` (all columns of docs), doc_id, and NEW."""
    sized = packed(docs, "doc_id", "text", "source").withColumn("size", n_words(F.col("text")))
    targets = source_targets(sized.select("source", "size"))
    targets = cut(targets.withColumnRenamed("source", "_s"))
    bound = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_s"), F.lit(0)) + 40), F.lit(0))).first()[0]
    if bound <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("rate", rate)
    own = F.md5(F.coalesce("text", F.lit("")))
    extra = (chance(F.col("doc_id"), F.col("source"), own) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra).select("__row", "doc_id", *NEW)


def mix(docs: DataFrame) -> DataFrame:
    """docs plus size, source_size, target, rate and `copies` (how often the mix takes a row).

    Each row is taken floor(rate) times, and once more with probability of the
    fraction, decided by a hash of its doc_id, source and text. Sources without
    words have rate 0. Null sources form one source; null texts have size 0;
    rows with null or repeated doc_ids draw by their texts; rows equal in all
    three get equal decisions. Columns of docs named like a new one give way.
    """
    return _decided(docs).select(*unpacked(docs.drop(*NEW)), *NEW)


def mix_summary(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it."""
    got = _decided(docs)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with its `copy` number from 1.

    A column of docs that is called copy gives way; all others stay.
    """
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return _decided(docs).filter("copies > 0").select(*unpacked(docs.drop("copy")), copy)


MIX_SQL = r"""
with s as (select doc_id, source, md5(coalesce(text, '')) as own, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
p as (select source, sum(size)::hugeint as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s group by source),
q as (select *, sum(source_size) over () as total,
             2 * coalesce(sum(source_size) over o, 0) as held,
             sum(w) over () - coalesce(sum(w) over o, 0) as free,
             row_number() over (order by 2.0::double * source_size::double / w::double, source nulls last) as n
      from p window o as (order by 2.0::double * source_size::double / w::double, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select *, 3 * total - 2 * held as rest, 4 * source_size * free <= (3 * total - 2 * held) * w as stops from q),
f as (select n as n0, rest as rest0, free as free0 from t where not stops order by n limit 1),
g as (select source, source_size::bigint as source_size,
             case when n0 is null or n < n0 then (2 * source_size)::double else (rest0 * w)::double / (2 * free0)::double end as target
      from t left join f on true),
m as (select s.doc_id, s.size, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size::double else 0.0::double end as rate,
             ('0x' || substr(sha256('mix-1|' || coalesce(s.doc_id::varchar, '?') || '|' || coalesce(s.source, '?') || '|' || s.own), 1, 13))::bigint::double / 4503599627370496.0::double as u
      from s join g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from m
"""
