"""Resolving tool references and resource URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.predicates import is_resource_ref
from palisade.sources.model import Graph

EMPTY = "array<string>"


def resolve_refs(tools: DataFrame, refs: DataFrame, few: bool = False) -> DataFrame:
    """(ref, keys): a ref with `::` names a key, a bare one a name; all matches in order, none -> empty.

    few: distinct refs are fewer than tools, so the tools are passed by them instead of being sorted.
    """
    wanted = refs.select("ref").distinct()
    if few:
        bare = ~F.contains("ref", F.lit("::"))
        named = lambda which, column: tools.select(F.col(column).alias("ref"), "key").join(wanted.filter(which).hint("shuffle_hash"), "ref")
        none = wanted.select("ref", F.lit(None).cast("string").alias("key"))
        found = named(~bare, "key").unionByName(named(bare, "name")).unionByName(none)
        return found.groupBy("ref").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    by_key = wanted.filter(F.contains("ref", F.lit("::"))).join(tools.select(F.col("key").alias("ref"), "key"), "ref", "left")
    by_name = wanted.filter(~F.contains("ref", F.lit("::"))).join(tools.select(F.col("name").alias("ref"), "key"), "ref", "left")
    # Grouped before the union: each side is already dealt by its references.
    every = lambda df: df.groupBy("ref").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return every(by_key).unionByName(every(by_name))


def resolution(keys: Column) -> Column:
    """found, not_found or ambiguous."""
    return F.when(F.size(keys) == 1, "found").when(F.size(keys) > 1, "ambiguous").otherwise("not_found")


def unique_resolution(tools: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, tool_key, problem): a key only where exactly one tool matches."""
    got = resolve_refs(tools, refs)
    problem = F.when(F.size("keys") > 1, "ambiguous").when(F.size("keys") == 0, "not found")
    return got.select("ref", F.when(F.size("keys") == 1, F.get("keys", F.lit(0))).alias("tool_key"), problem.alias("problem"))


def resolve_grants(tools: DataFrame, grants: DataFrame) -> DataFrame:
    """grants(agent, ref) plus tool_key and status: bare refs adopt the only match, several are AMBIGUOUS_GRANT, none keeps the ref."""
    bare = ~F.contains("ref", F.lit("::"))
    got = grants.join(resolve_refs(tools, grants.filter(bare)), "ref", "left")
    n = F.coalesce(F.size("keys"), F.lit(0))
    key = F.when(bare & (n == 1), F.get("keys", F.lit(0))).when(bare & (n > 1), F.lit(None)).otherwise(F.col("ref"))
    return got.select("agent", "ref", key.alias("tool_key"), F.when(bare & (n > 1), "AMBIGUOUS_GRANT").alias("status"))


def agent_present(graph: Graph, agents: DataFrame) -> DataFrame:
    """agents(agent) plus `found`."""
    known = graph.agents.select(F.col("id").alias("agent"), F.lit(True).alias("_f")).distinct()
    return agents.join(known, "agent", "left").select("agent", F.coalesce("_f", F.lit(False)).alias("found"))


#: Ports that a scheme implies.
DEFAULT_PORTS = {"http": "80", "https": "443"}


def _without_dots(path: Column) -> Column:
    """Remove . and .. segments of a path that begins with /."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")

    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.array_append(acc, s))

    kept = F.aggregate(parts, F.array().cast(EMPTY), step)
    last = F.element_at(parts, -1)
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def canonical_uri(uri: Column) -> Column:
    """One form for equal resources: lower-case scheme; for http and https lower-case host, no default port, no dot segments, `/` for an empty path.

    A value that is not of the form scheme:rest stays as it is.
    """
    shape = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(.*)\z"
    scheme, rest = F.lower(F.regexp_extract(uri, shape, 1)), F.regexp_extract(uri, shape, 2)
    web = r"(?s)^//([^/?#]*@)?([^/?#@:]+|\[[^\]]*\])(?::([0-9]*))?(/[^?#]*)?([?#].*)?\z"
    user, host, port, path, tail = (F.regexp_extract(rest, web, i) for i in range(1, 6))
    implied = F.coalesce(*[F.when(scheme == s, F.lit(p)) for s, p in DEFAULT_PORTS.items()], F.lit(""))
    shown_port = F.when((port == "") | (port == implied), "").otherwise(F.concat(F.lit(":"), port))
    shown_path = F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), _without_dots(path)).otherwise(path)
    whole = F.concat(scheme, F.lit("://"), user, F.lower(host), shown_port, shown_path, tail)
    fine = scheme.isin(*DEFAULT_PORTS) & rest.rlike(web)
    return F.when(uri.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:") & ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*::"), F.when(fine, whole).otherwise(F.concat(scheme, F.lit(":"), rest))).otherwise(uri)


def uri_report(uris: DataFrame) -> DataFrame:
    """(uri, canonical, changed, collides) of distinct uris: which values change, and which fall together."""
    got = uris.select("uri").distinct().withColumn("canonical", canonical_uri(F.col("uri")))
    n = got.groupBy("canonical").agg((F.count("*") > 1).alias("collides"))
    return got.join(n, "canonical").select("uri", "canonical", (F.col("uri") != F.col("canonical")).alias("changed"), "collides")


def ref_kind(ref: Column) -> Column:
    return F.when(is_resource_ref(ref), "resource").otherwise("tool")
