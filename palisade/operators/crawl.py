"""Applying crawls to the graph: upserts, stale edges, retirement and fleet checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.predicates import tool_key
from palisade.operators.audit import authored_keys
from palisade.operators.resolve import canonical_uri
from palisade.sources.model import HINTS, PROV, Graph

#: Bounds of one server's kept records. Fixed values of the intake contract.
MAX_RECORDS, MAX_BYTES = 10_000, 4 << 20


def last_of(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last row per key in an order; rows equal in it go by their other values, so reruns agree.

    A maximum, which tasks form of their own rows first: a key with many rows
    moves as one row a task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in rows.columns])


def in_order(rows: DataFrame) -> tuple[str, ...]:
    """The columns that order what crawls list: the crawl, if it is there, then the position."""
    return tuple(c for c in ("crawl", "seq") if c in rows.columns)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old rows whose key is not in new, and all of new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_servers(servers: DataFrame, crawled: DataFrame) -> DataFrame:
    """Insert or replace by name, stamped with the crawl's time."""
    new = crawled.withColumn("last_crawled_at", F.coalesce(F.col("crawled_at"), F.current_timestamp())) if "crawled_at" in crawled.columns else crawled.withColumn("last_crawled_at", F.current_timestamp())
    return replace_rows(servers, new.select(*servers.columns), ["name"])


def upsert_tools(tools: DataFrame, listed: DataFrame) -> DataFrame:
    """Insert or replace by key; hints are set as listed, so a dropped hint becomes null; the last duplicate wins."""
    return replace_rows(tools, last_of(listed, ["key"], in_order(listed)), ["key"])


def upsert_resources(resources: DataFrame, listed: DataFrame) -> DataFrame:
    """Insert or replace by canonical uri; a shared resource takes the fields of the last crawl that lists it, there of the last position."""
    return replace_rows(resources, last_of(listed.withColumn("uri", canonical_uri(F.col("uri"))), ["uri"], in_order(listed)), ["uri"])


def drop_stale_edges(edges: DataFrame, crawled: DataFrame, listed: DataFrame, to: str) -> DataFrame:
    """edges(server, to, prov) after a crawl: those of crawled servers are replaced by what the servers list."""
    servers = crawled.select(F.col("name").alias("server")).distinct()
    kept = edges.join(servers, "server", "left_anti")
    prov = F.struct(F.lit("crawled").alias("source"), F.lit("high").alias("confidence"), F.concat(F.lit("crawled from "), F.coalesce("endpoint", "server")).alias("evidence")).cast(PROV)
    fresh = listed.select("server", to).distinct().join(crawled.select(F.col("name").alias("server"), "endpoint"), "server").select("server", to, prov.alias("prov"))
    return kept.unionByName(fresh)


def unlisted_tools(graph: Graph, servers: DataFrame, listed: DataFrame) -> DataFrame:
    """(tool_key, server): tools of the given servers that the servers no longer list."""
    mine = graph.tools.select(F.col("key").alias("tool_key"), "server").join(servers.select(F.col("name").alias("server")).distinct(), "server", "left_semi")
    return mine.join(listed.select("tool_key"), "tool_key", "left_anti").select("tool_key", "server")


def clear_stale_hints(tools: DataFrame, unlisted: DataFrame) -> DataFrame:
    """tools with the four hints of unlisted ones set to null."""
    got = tools.join(unlisted.select(F.col("tool_key").alias("key"), F.lit(True).alias("_u")).distinct(), "key", "left")
    return got.select(*[F.when(F.col("_u").isNull(), F.col(c)).alias(c) if c in HINTS else F.col(c) for c in tools.columns])


def drop_ungoverned(graph: Graph, unlisted: DataFrame) -> DataFrame:
    """Unlisted tools with no authored edge: these go."""
    return unlisted.join(authored_keys(graph), "tool_key", "left_anti")


def kept_warnings(graph: Graph, unlisted: DataFrame) -> DataFrame:
    """(tool_key, message): one warning per unlisted tool that stays because it is governed."""
    kept = unlisted.join(authored_keys(graph), "tool_key", "left_semi")
    return kept.select("tool_key", F.format_string("tool '%s' is no longer exposed by '%s' but keeps its authored edges", "tool_key", "server").alias("message"))


def resource_endpoints(provides: DataFrame, graph: Graph) -> DataFrame:
    return provides.select("uri").union(graph.data_access.select("uri")).union(graph.governed_resource.select("uri")).distinct()


def apply_crawl(graph: Graph, servers: DataFrame, tools: DataFrame, resources: DataFrame) -> Graph:
    """The graph after a crawl of some servers.

    servers(name, version, transport, endpoint), tools(the tool columns, seq),
    resources(server, the resource columns, seq); tools and resources may have
    `crawl`, the order of the crawls. Other servers stay as they are.
    """
    listed = tools.select(F.col("key").alias("tool_key"), "server")
    shown = resources.withColumn("uri", canonical_uri(F.col("uri")))
    gone = unlisted_tools(graph, servers, listed)
    removed = drop_ungoverned(graph, gone)
    kept_tools = clear_stale_hints(graph.tools, gone).join(removed.select(F.col("tool_key").alias("key")), "key", "left_anti")
    provides = drop_stale_edges(graph.provides, servers, shown.select("server", "uri"), "uri")
    stale = graph.provides.select("uri").join(provides.select("uri"), "uri", "left_anti").distinct()
    orphaned = stale.join(resource_endpoints(provides, graph), "uri", "left_anti")
    return graph.with_tables(
        servers=upsert_servers(graph.servers, servers),
        tools=upsert_tools(kept_tools.select(*graph.tools.columns), tools),
        resources=upsert_resources(graph.resources.join(orphaned, "uri", "left_anti").select(*graph.resources.columns), shown),
        exposes=drop_stale_edges(graph.exposes, servers, listed, "tool_key"),
        provides=provides,
    )


def fleet_keep(specs: DataFrame, results: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names to keep, blockers): a failed spec without a name stops retirement."""
    named = [df.select("name").filter("name is not null and name <> ''") for df in (specs, results)]
    return named[0].union(named[1]).distinct(), failures.filter("name is null or name = ''")


def duplicate_names(*claims: DataFrame) -> DataFrame:
    """(name, n) of names claimed more than once; null and '' are no names."""
    every = reduce(DataFrame.union, [c.select("name") for c in claims])
    return every.filter("name is not null and name <> ''").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def retire_servers(graph: Graph, keep: DataFrame) -> Graph:
    """The graph without servers outside keep(name); their governed tools stay, without hints."""
    out = graph.servers.join(keep.select("name").distinct(), "name", "left_anti").select("name")
    none = graph.exposes.limit(0).select("tool_key")
    gone = unlisted_tools(graph, out, none)
    removed = drop_ungoverned(graph, gone).select(F.col("tool_key").alias("key"))
    names = out.select(F.col("name").alias("server"))
    provides = graph.provides.join(names, "server", "left_anti")
    orphaned = graph.provides.join(names, "server", "left_semi").select("uri").distinct().join(resource_endpoints(provides, graph), "uri", "left_anti")
    return graph.with_tables(
        servers=graph.servers.join(out, "name", "left_anti").select(*graph.servers.columns),
        tools=clear_stale_hints(graph.tools, gone).join(removed, "key", "left_anti").select(*graph.tools.columns),
        resources=graph.resources.join(orphaned, "uri", "left_anti").select(*graph.resources.columns),
        exposes=graph.exposes.join(names, "server", "left_anti").select(*graph.exposes.columns),
        provides=provides.select(*graph.provides.columns),
    )


def catalog_budget(records: DataFrame, columns: list[str], most_records: int = MAX_RECORDS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(server, records, bytes, refused): servers whose records exceed a bound."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}))
    got = records.groupBy("server").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))
    return got.withColumn("refused", (F.col("records") > most_records) | (F.col("bytes") > most_bytes))


def composed_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with tool_key, refused rows): parts that hold `::` can't form a key."""
    got = rows.withColumn("tool_key", tool_key(F.col("server"), F.col("tool")))
    return got.filter("tool_key is not null"), got.filter("tool_key is null").drop("tool_key")


def endpoint_label(transport: Column, value: Column) -> Column:
    """What may be stored of an endpoint: the executable's base name for stdio, scheme://host:port for the web."""
    command = F.regexp_extract(F.trim(value), r"""^(?:"([^"]*)"|'([^']*)'|(\S+))""", 0)
    name = F.regexp_replace(F.regexp_replace(command, r"""^["']|["']$""", ""), r"^.*[/\\]", "")
    web = r"(?i)^(https?)://(?:[^/?#]*@)?([^/?#@]+)"
    label = F.concat(F.lower(F.regexp_extract(value, web, 1)), F.lit("://"), F.lower(F.regexp_extract(value, web, 2)))
    return F.when(transport == "stdio", F.when(name != "", name)).when(value.rlike(web), label)
