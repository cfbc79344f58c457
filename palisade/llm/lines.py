"""Cross-site line dedup by distinct-site spread, in DataFrame functions only.

A line seen on many sites is boilerplate. One aggregation per line hash merges
HyperLogLog sketches of the sites; lines whose estimate is near the threshold
are counted exactly. Every occurrence is removed but the one in the line's
first document (least doc_id), so that the text of whole-document copies stays
in the corpus once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.spans import cut, packed, text_key, unpacked

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 5
#: Shorter lines (code points, trimmed) recur by chance; they are boilerplate on this many distinct sites. With least length 1 all lines are treated alike.
MIN_CHARS = 20
SHORT_SITES = 10
#: Sketch size 2^LG_K; relative error 1.04 / sqrt(2^LG_K).
LG_K = 10


def bare_line(line: Column) -> Column:
    """A line without spaces, tabs and carriage returns at its ends."""
    return F.trim(line, F.lit(" \t\r"))


def line_key(line: Column) -> tuple[Column, Column]:
    """128 bits of a bare line."""
    bare = bare_line(line)
    return F.xxhash64(bare), F.xxhash64(F.lit("second"), bare)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, pos, h1, h2, site, doc_id, need) for each line that is not blank, with the sites asked of it; texts stay behind."""
    k1, k2 = text_key(F.col("text"))
    h1, h2 = line_key(F.col("_line"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("site"), k1.alias("k1"), k2.alias("k2"), F.posexplode(F.split("text", "\n")).alias("pos", "_line"))
    size = F.length(bare_line(F.col("_line")))
    need = F.when(size < min_chars, SHORT_SITES).otherwise(MIN_SITES)
    return rows.filter(size > 0).select("k1", "k2", "pos", h1.alias("h1"), h2.alias("h2"), "site", "doc_id", need.alias("need"))


def boilerplate(rows: DataFrame) -> DataFrame:
    """(h1, h2, first_id): line hashes on as many sites as they need or more, and the least doc_id that holds them.

    An estimate outside the band of four standard errors around the threshold
    decides by itself; within it the distinct sites are counted exactly.
    """
    band = 4 * 1.04 / (1 << LG_K) ** 0.5
    low, high = F.floor(F.col("need") * (1 - band)), F.ceil(F.col("need") * (1 + band))
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    spread = cut(rows.groupBy("h1", "h2").agg(sketch.alias("est"), F.min("doc_id").alias("first_id"), F.max("need").alias("need")).filter(F.col("est") >= low))
    near = spread.filter(F.col("est") <= high)
    exact = rows.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    counted = near.join(exact, ["h1", "h2"]).filter(F.col("sites") >= F.col("need"))
    return spread.filter(F.col("est") > high).select("h1", "h2", "first_id").unionByName(counted.select("h1", "h2", "first_id"))


def without(lines: Column, gone: Column) -> Column:
    """lines without those at the given positions.

    The lambda binds the array of lines once, and the remaining positions come
    from a hashed set, so the work is linear in the lines.
    """
    left = F.transform(F.array(lines), lambda every: F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone), lambda i: F.get(every, i)))
    return F.element_at(left, 1)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines removed from `text`, plus n_lines and n_removed.

    The first document of a line keeps it. Null texts stay null with 0 lines;
    a text that loses all its lines becomes empty; no row is dropped. A null
    source is a site of its own. n_chars, if there, follows the new text;
    columns of docs called n_lines or n_removed give way.
    Documents with the same (also null) doc_id count as one for "first".
    min_chars=1 asks MIN_SITES of every line.
    """
    rows = line_rows(docs, min_chars)
    hits = (
        rows.join(boilerplate(rows), ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("k1", "k2", "doc_id")
        .agg(F.collect_set("pos").alias("_hits"))
        .withColumnsRenamed({"k1": "_k1", "k2": "_k2", "doc_id": "_id"})
    )
    k1, k2 = text_key(F.col("text"))
    keyed = packed(docs, "doc_id", "text").withColumns({"_d1": k1, "_d2": k2})
    same = (F.col("_d1") == F.col("_k1")) & (F.col("_d2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_id"))

    lines = F.split("text", "\n")
    kept = F.when(F.col("_hits").isNull(), lines).otherwise(without(lines, F.col("_hits")))
    out = keyed.join(hits, same, "left").withColumn("_kept", kept)
    null = F.col("text").isNull()
    n_lines = F.when(null, 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(null, 0).otherwise(F.size(lines) - F.size("_kept")).cast("long")
    text = F.array_join("_kept", "\n")
    new = {"text": text} | ({"n_chars": F.length(text)} if "n_chars" in docs.columns else {})
    rest = docs.drop("n_lines", "n_removed")
    return out.select(*unpacked(rest, new), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


_BARE = "trim(line, ' ' || chr(9) || chr(13))"
LINES_SQL = f"""
with l as (select doc_id, coalesce(source, '') as site, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
b as (select {_BARE} as bare, min(doc_id) as first_id from l where {_BARE} <> '' group by 1 having count(distinct site) >= case when length({_BARE}) < {MIN_CHARS} then {SHORT_SITES} else {MIN_SITES} end),
k as (select l.*, b.bare is not null and l.doc_id is distinct from b.first_id as gone from l left join b on {_BARE} = b.bare)
select d.doc_id, coalesce(x.n_lines, 0)::bigint as n_lines, coalesce(x.n_removed, 0)::bigint as n_removed,
       case when d.text is null then null else coalesce(x.kept, '') end as text
from documents d left join (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by pos) filter (where not gone) as kept
  from k group by doc_id) x using (doc_id)
"""
