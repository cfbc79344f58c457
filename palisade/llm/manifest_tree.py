"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

Leaves take places by range partitions and offsets, so no source has to fit
into one task. Levels are made of runs of FAN siblings, each level a sixteenth
of the one below. Tampering with a leaf makes a new version of the tree that
shares all untouched nodes: inside an aligned block of BLOCK leaves a task
copies the leaf's ancestors in a persistent tree; above it the version goes on
with the siblings that the block's place in the distributed upper levels names.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import CRC_TABLE_SQL, ascii_lower, crc32_sql, cut, cut_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, INSIDE = 16, 2
BLOCK = FAN**INSIDE
#: Leaves whose crc32 of the decimal id this number divides are tampered with.
TAMPER = 5


def written(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[written(v) for v in values]), 256)


def source_key(source: Column) -> Column:
    """A string that is never null and sorts like the source, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows plus `pos` (from 0 in each group, nulls first) and `n` (the group's rows)."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    held = cut(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_at", 33))
    parts = held.groupBy(group, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_begin"))
    # One row per group and task.
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    every = F.sum("_n").over(Window.partitionBy(group))
    starts = parts.select(group, "_task", (F.coalesce(earlier, F.lit(0)) - F.col("_begin")).alias("_shift"), every.alias("n"))
    return held.join(starts, [group, "_task"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


class Levels(NamedTuple):
    """runs[l]: (key, n, up, items) of level l, for trees with more than one node there. roots: (key, n, digest)."""

    runs: list[DataFrame]
    roots: DataFrame


def levels(nodes: DataFrame) -> Levels:
    """The trees over nodes(key, n, idx, digest), level by level; n is a tree's number of leaves."""
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    runs, roots, size = [], [], 1
    while size < most:
        roots.append(nodes.filter(F.col("n") <= size))
        up = F.floor(F.col("idx") / FAN).alias("up")
        run = nodes.filter(F.col("n") > size).groupBy("key", "n", up).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("items"))
        run = cut(run) if runs else cut_table(run)
        runs.append(run)
        nodes = run.select("key", "n", F.col("up").alias("idx"), F.sha2(F.array_join("items.digest", ""), 256).alias("digest"))
        size *= FAN
    roots.append(nodes)
    return Levels(runs, reduce(DataFrame.unionByName, roots).select("key", "n", "digest"))


SIDES = "array<struct<left:string,right:string>>"


def contexts(runs: list[DataFrame], tops: DataFrame, lowest: int) -> DataFrame:
    """(key, idx, subroot, sides) of every node of level `lowest`: its siblings left and right, then its ancestors'.

    tops(key, n, subroot, sides): the same of each tree's root.
    """
    at_top = lambda level: tops.filter(F.col("n") <= FAN**level).select("key", F.lit(0).cast("long").alias("idx"), "subroot", "sides")
    known = at_top(max(lowest, len(runs)))
    for level in reversed(range(lowest, len(runs))):
        r = runs[level].withColumnRenamed("up", "idx").select("key", "idx", "items").join(known, ["key", "idx"])
        each = r.select("key", "subroot", "sides", F.col("items.digest").alias("all"), F.posexplode("items").alias("i", "item"))
        own = F.struct(F.array_join(F.slice("all", 1, F.col("i")), "").alias("left"), F.array_join(F.slice("all", F.col("i") + 2, F.lit(FAN)), "").alias("right"))
        below = each.select("key", F.col("item.idx").alias("idx"), "subroot", F.concat(F.array(own), "sides").alias("sides"))
        known = below.unionByName(tops.filter((F.col("n") <= FAN**level)).select("key", F.lit(0).cast("long").alias("idx"), "subroot", "sides"))
    return known


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Node(NamedTuple):
    """A node of a persistent tree: never changed, shared between versions."""

    digest: str
    below: tuple = ()


def grown(leaves: list[str], height: int) -> Node:
    """The block's tree: `height` levels above its leaves."""
    nodes = [Node(x) for x in leaves]
    for _ in range(height):
        runs = [tuple(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        nodes = [Node(hashed("".join(x.digest for x in run)), run) for run in runs]
    return nodes[0]


def path_of(i: int, height: int) -> list[int]:
    """Child numbers from the block's root down to leaf i."""
    return [i // FAN**h % FAN for h in reversed(range(height))]


def copied(node: Node, path: list[int], leaf: str) -> Node:
    """A version of the tree with another leaf: new nodes on the path only."""
    if not path:
        return Node(leaf)
    k = path[0]
    below = (*node.below[:k], copied(node.below[k], path[1:], leaf), *node.below[k + 1 :])
    return Node(hashed("".join(x.digest for x in below)), below)


def along(node: Node, path: list[int]) -> list[Node]:
    """The nodes from the root to a leaf."""
    out = [node]
    for k in path:
        out.append(out[-1].below[k])
    return out


COPIES = "array<struct<level:int,idx:long,digest:string>>"


def versions(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copies.

    tampered: whether a row's text is lower-cased (default: TAMPER divides the
    id's crc32). `copies` lists the nodes that a tampered row's version does
    not share: its path from leaf to root, (level, idx in the level, digest),
    levels counted through its source's tree and on through the tree of
    sources. Null values count as `-`, null ids are not tampered with and come
    first; rows with equal ids go by their digests, equal rows stay repeated.
    An empty table gives no rows. Columns of docs beyond `fields` are not read.
    """
    if tampered is None:
        tampered = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % TAMPER == 0, F.lit(False))
    changed = [ascii_lower(docs[f]) if f == text else docs[f] for f in fields]
    leaf = digest([docs[f] for f in fields])
    leaves = cut_table(docs.select(source_key(docs["source"]).alias("key"), docs["doc_id"].alias("doc_id"), leaf.alias("leaf"), F.when(tampered, digest(changed)).alias("alt")))
    rows = cut_table(placed(leaves, "key", ["doc_id", "leaf"]))
    own = levels(rows.select("key", "n", F.col("pos").alias("idx"), F.col("leaf").alias("digest")))
    # The tree of sources is built the same way, under one key.
    sources = cut(placed(own.roots.select(F.lit("").alias("all"), "key", F.col("n").alias("leaves"), "digest"), "all", ["key"]))
    upper = levels(sources.select(F.lit("").alias("key"), "n", F.col("pos").alias("idx"), "digest"))
    found = upper.roots.first()
    root = found.digest if found else ""
    top = upper.roots.select("key", "n", F.lit("").alias("subroot"), F.array().cast(SIDES).alias("sides"))
    place = contexts(upper.runs, top, 0).select(F.col("idx").alias("pos"), "sides")
    tops = cut(sources.join(place, "pos").select("key", F.col("leaves").alias("n"), F.col("digest").alias("subroot"), "sides", F.col("pos").alias("place")))
    blocks = contexts(own.runs, tops.drop("place"), INSIDE).withColumnRenamed("idx", "block")
    places = tops.select("key", "place")
    blocks = blocks.join(places, "key")
    deal = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    schema = schema.add("verified", T.BooleanType()).add("copies", T._parse_datatype_string(COPIES))

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of leaves and the one row of its place in the tree."""
        left = left.sort_by("pos")
        pos, leaf, alt, n = (left.column(c).to_pylist() for c in ("pos", "leaf", "alt", "n"))
        if not pos:
            return pa.Table.from_pydict({f.name: [] for f in schema}, schema=arrow)
        subroot, place = right.column("subroot")[0].as_py(), right.column("place")[0].as_py()
        sides = [(s["left"], s["right"]) for s in right.column("sides")[0].as_py()]
        height = next(h for h in range(INSIDE + 1) if h == INSIDE or n[0] <= FAN**h)
        levels_below = height + next(d for d in range(64) if n[0] <= FAN ** (d + height))  # of the source's own tree
        tree, out = grown(leaf, height), {f.name: [] for f in schema if f.name not in ("doc_id", "leaf")}
        above = [a + b for a, b in sides]
        for i, changed in enumerate(alt):
            path = path_of(i, height)
            nodes = along(tree, path)
            beside = ["".join(x.digest for j, x in enumerate(nodes[d].below) if j != path[d]) for d in reversed(range(height))]
            version = tree if changed is None else copied(tree, path, changed)
            made = [x.digest for x in reversed(along(version, path))]
            for before, after in sides:
                made.append(hashed(before + made[-1] + after))
            out["subroot"].append(subroot)
            out["root"].append(root)
            out["proof_sha256"].append(hashed("".join(beside + above)))
            out["folded_root"].append(made[-1])
            out["verified"].append(made[-1] == root)
            level_idx = [pos[i] // FAN**d if d <= levels_below else place // FAN ** (d - levels_below) for d in range(len(made))]
            out["copies"].append(None if changed is None else [{"level": d, "idx": k, "digest": x} for d, (k, x) in enumerate(zip(level_idx, made, strict=True))])
        return pa.Table.from_arrays([left.column("doc_id"), left.column("leaf"), *[pa.array(v, arrow.field(k).type) for k, v in out.items()]], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return deal.select("key", "block", "pos", "n", "doc_id", "leaf", "alt").groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(prove, schema)


def manifest_summary(docs: DataFrame) -> DataFrame:
    return versions(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _levels_sql(name: str, by: str, top: int) -> str:
    """CTEs {name}0.. up to level `top`, each node with its siblings left (l) and right (r)."""
    out = []
    for h in range(top + 1):
        if h:
            out.append(f"{name}{h}_ as (select {by}, n, idx // {FAN} as idx, sha256(string_agg(d, '' order by idx)) as d from {name}{h - 1} where n > {FAN ** (h - 1)} group by {by}, n, idx // {FAN})")
        run = f"(partition by {by}, idx // {FAN} order by idx rows between"
        out.append(f"""{name}{h} as (select *, coalesce(string_agg(d, '') over {run} unbounded preceding and 1 preceding), '') as l,
            coalesce(string_agg(d, '') over {run} 1 following and unbounded following), '') as r from {name}{h}_)""")
    return ",\n".join(out)


def _folds_sql(first: str, name: str, by: str, at: str, top: int, out: str) -> str:
    """CTEs that carry `proof` and `fold` of every document from its leaf (or subroot) up."""
    made, last = [], first
    for h in range(top):
        this = out if h == top - 1 else f"{out}{h}"
        made.append(f"""{this} as (select f.* exclude (proof, fold), proof || case when x.d is null or f.{at}_n <= {FAN**h} then '' else x.l || x.r end as proof,
            case when x.d is null or f.{at}_n <= {FAN**h} then fold else sha256(x.l || fold || x.r) end as fold
            from {last} f left join {name}{h} x on x.{by} is not distinct from f.{by} and x.idx = f.{at} // {FAN**h})""")
        last = this
    return ",\n".join(made)


def _written_sql(v: str) -> str:
    return f"case when {v} is null then '-' else strlen({v}::varchar)::varchar || ':' || {v}::varchar end"


#: Stated for up to a million leaves a source and 65,536 sources.
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MANIFEST_SQL = f"""
with {CRC_TABLE_SQL},
d as (select doc_id, source, sha256({" || ".join(_written_sql(f) for f in FIELDS)}) as leaf,
      case when {crc32_sql("doc_id::varchar")} % {TAMPER} = 0 then sha256({" || ".join(_written_sql(_LOW if f == "text" else f) for f in FIELDS)}) end as alt from documents, crc),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from d),
a0_ as (select source, n, idx, leaf as d from p),
{_levels_sql("a", "source", 5)},
s as (select source, d as subroot from ({" union all ".join(f"select source, d from a{h} where n <= {FAN**h}" for h in range(6))})),
t as (select *, 1 as every, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from s),
b0_ as (select every, n, idx, subroot as d from t),
{_levels_sql("b", "every", 4)},
top as (select d as root from ({" union all ".join(f"select d from b{h} where n <= {FAN**h}" for h in range(5))})),
f as (select p.doc_id, p.source, p.leaf, t.subroot, 1 as every, p.idx as doc_at, p.n as doc_at_n, t.idx as src_at, t.n as src_at_n, '' as proof, coalesce(p.alt, p.leaf) as fold from p join t on p.source is not distinct from t.source),
{_folds_sql("f", "a", "source", "doc_at", 5, "g")},
{_folds_sql("g", "b", "every", "src_at", 4, "h")}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, fold as folded_root, fold = root as verified from h, top
"""
