"""Which agents reach a DENY policy, by which path, and whether that is excepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.predicates import short_name
from palisade.operators.scrub import display_resource
from palisade.sources.model import PROV, Graph


def deny_policies(graph: Graph) -> DataFrame:
    return graph.policies.filter("effect = 'DENY'").select(F.col("id").alias("policy"))


def denied_resources(graph: Graph) -> DataFrame:
    """(uri, policy, gov): resource bindings to DENY policies."""
    # A policy has one row, so a semi join is the same, and its size is known to be no larger than the bindings'.
    return graph.governed_resource.join(deny_policies(graph), "policy", "left_semi").select("uri", "policy", F.col("prov").alias("gov"))


def of_asked(rows: DataFrame, asked: DataFrame | None, *keys: str) -> DataFrame:
    """The rows whose keys are asked for; all without asked. What is asked is the smaller side, so the rows are not sorted."""
    return rows if asked is None else rows.join(asked.hint("shuffle_hash"), list(keys), "left_semi")


def tool_deny_paths(graph: Graph, asked: DataFrame | None = None) -> DataFrame:
    """Every way a tool (of asked(tool_key), if given) reaches a DENY policy, whether or not anyone may call it.

    via = resource: the tool reads or writes a governed resource; via = tool:
    the tool itself is governed. `prov` is the load-bearing edge's.
    """
    by_resource, by_tool = _tool_routes(graph, asked)
    return by_resource.unionByName(by_tool)


def _tool_routes(graph: Graph, asked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The two parts of tool_deny_paths: by resource and by tool."""
    by_resource = of_asked(graph.data_access, asked, "tool_key").join(denied_resources(graph), "uri").select(F.lit("resource").alias("via"), "tool_key", "mode", F.col("uri").alias("resource"), "policy", "prov", "gov")
    none = F.lit(None)
    by_tool = of_asked(graph.governed_tool, asked, "tool_key").join(deny_policies(graph), "policy", "left_semi").select(
        F.lit("tool").alias("via"), "tool_key", none.cast("string").alias("mode"), none.cast("string").alias("resource"), "policy", "prov", none.cast(PROV).alias("gov")
    )
    return by_resource, by_tool


def deny_by_resource(graph: Graph) -> DataFrame:
    return deny_paths(graph).filter("via = 'resource'").drop("via")


def deny_by_tool(graph: Graph) -> DataFrame:
    return deny_paths(graph).filter("via = 'tool'").select("agent", "tool_key", "policy", "prov")


def deny_paths(graph: Graph) -> DataFrame:
    """tool_deny_paths for each agent that may call the tool."""
    return graph.can_call.select("agent", "tool_key").join(tool_deny_paths(graph), "tool_key").select("via", "agent", "tool_key", "mode", "resource", "policy", "prov", "gov")


def match_exceptions(paths: DataFrame, exceptions: DataFrame) -> DataFrame:
    """paths plus `excepted` and `exception_reason`.

    An exception holds for its own resource, or for every path when it names
    none; the specific one is reported even if its reason is null. Two equi
    joins keep one row per path.
    """
    one = exceptions.groupBy("agent", "tool_key", "policy", "resource").agg(F.max("reason").alias("reason"))
    special = one.filter("resource is not null").select("agent", "tool_key", "policy", "resource", F.lit(True).alias("_s"), F.col("reason").alias("_s_reason"))
    whole = one.filter("resource is null").select("agent", "tool_key", "policy", F.lit(True).alias("_w"), F.col("reason").alias("_w_reason"))
    both = paths.join(special, ["agent", "tool_key", "policy", "resource"], "left").join(whole, ["agent", "tool_key", "policy"], "left")
    reason = F.when(F.col("_s"), F.col("_s_reason")).otherwise(F.col("_w_reason"))
    return both.select(*paths.columns, (F.coalesce("_s", F.lit(False)) | F.coalesce("_w", F.lit(False))).alias("excepted"), reason.alias("exception_reason"))


def classification(excepted: Column) -> Column:
    return F.when(excepted, "authorized_but_governed").otherwise("violation")


def evidence_path(tool_key: Column, mode: Column, resource: Column, policy: Column) -> Column:
    """The path as text; the tool route has no resource."""
    tool, shown = short_name(tool_key), display_resource(policy)
    whole = F.format_string("(%s) -GOVERNED_BY-> (%s:DENY)", tool, shown)
    return F.when(resource.isNull(), whole).otherwise(F.format_string("(%s) -%s-> (%s) -GOVERNED_BY-> (%s:DENY)", tool, mode, display_resource(resource), shown))


def policy_provenance(gov: Column) -> Column:
    """A binding's provenance, where it cites evidence or its source is not the default."""
    plain = gov["evidence"].isNull() & (gov["source"].isNull() | (gov["source"] == "operator_asserted"))
    return F.when(gov.isNotNull() & ~plain, gov)


def described(paths: DataFrame) -> DataFrame:
    """paths (after match_exceptions) with classification, path text and policy provenance."""
    return paths.withColumns(
        {
            "classification": classification(F.col("excepted")),
            "path": evidence_path(F.col("tool_key"), F.col("mode"), F.col("resource"), F.col("policy")),
            "policy_prov": policy_provenance(F.col("gov")),
        }
    ).drop("excepted", "gov")


def classified_paths(graph: Graph) -> DataFrame:
    """Deny paths of all agents with their classification."""
    return described(match_exceptions(deny_paths(graph), graph.exceptions))


def unsafe_tools(graph: Graph, include_authorized: bool = False) -> DataFrame:
    """Deny paths per agent with the number of them and whether the agent exists; agents without paths have one empty row."""
    paths = classified_paths(graph)
    if not include_authorized:
        paths = paths.filter("classification = 'violation'")
    counted = paths.groupBy("agent").agg(F.count("*").alias("count"))
    return graph.agents.select(F.col("id").alias("agent")).join(counted, "agent", "left").select("agent", F.lit(True).alias("agent_found"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def listed_deny_paths(graph: Graph, asked: DataFrame | None = None, told: bool = True) -> DataFrame:
    """(tool_key, tool_paths): tool_deny_paths as a list of each tool that has some; of policies and resources only unless paths are to be told."""
    # A tool touches few resources, and a path needs a binding of each: the list is bounded by the tool's own edges.
    row = F.collect_list(F.struct(*(("via", "mode", "resource", "policy", "prov", "gov") if told else ("resource", "policy"))))
    if asked is None:
        return tool_deny_paths(graph).groupBy("tool_key").agg(row.alias("tool_paths"))
    # Both routes are dealt by tool here. A union of them would count as dealt so too, but adaptive execution may
    # deal its sides differently later, and a join with it then fails; so each route is joined by itself.
    got = asked.select("tool_key").distinct()
    for name, paths in zip(("_r", "_t"), _tool_routes(graph, asked), strict=True):
        got = got.join(paths.groupBy("tool_key").agg(row.alias(name)), "tool_key", "left")
    return got.filter("_r is not null or _t is not null").select("tool_key", F.flatten(F.array_compact(F.array("_r", "_t"))).alias("tool_paths"))


def with_evidence(rows: DataFrame, exceptions: DataFrame, pairs: DataFrame | None = None, told: bool = True) -> DataFrame:
    """rows(agent, tool_key, tool_paths, ...) with `deny_paths` in the place of tool_paths: each path described for the agent, in order.

    What match_exceptions tells, by one join on pairs: an agent's exceptions of
    one tool are a list, bounded by the paths that they except. pairs: the
    (agent, tool_key) of rows, where others' exceptions need not be gathered.
    Unless they are to be told, paths have their classification only, in no order.
    """
    dealt = exceptions.repartition("agent", "tool_key") if pairs is None else of_asked(exceptions, pairs, "agent", "tool_key")
    if told:
        one = dealt.groupBy("agent", "tool_key", "policy", "resource").agg(F.max("reason").alias("reason"))
        held = one.groupBy("agent", "tool_key").agg(F.collect_list(F.struct("policy", "resource", "reason")).alias("_held"))
    else:
        held = dealt.groupBy("agent", "tool_key").agg(F.collect_set(F.struct("policy", "resource")).alias("_held"))
    got = rows.join(held, ["agent", "tool_key"], "left")
    holds = lambda e, p: (e["policy"] == p["policy"]) & (e["resource"].isNull() | (e["resource"] == p["resource"]))
    if not told:
        excepted = lambda p: F.coalesce(F.exists("_held", lambda e: holds(e, p)), F.lit(False))
        return got.withColumn("deny_paths", F.transform("tool_paths", lambda p: F.struct(classification(excepted(p)).alias("classification")))).drop("tool_paths", "_held")

    def told_of(p: Column) -> Column:
        same = F.filter("_held", lambda e: holds(e, p))
        # The specific exception comes before the one of all paths.
        best = F.get(F.array_sort(F.transform(same, lambda e: F.struct(e["resource"].isNull().alias("w"), e["reason"].alias("reason")))), F.lit(0))
        excepted = F.coalesce(F.size(same), F.lit(0)) > 0
        return F.struct(
            p["via"].alias("via"), p["mode"].alias("mode"), p["resource"].alias("resource"), p["policy"].alias("policy"), classification(excepted).alias("classification"), best["reason"].alias("exception_reason"),
            evidence_path(F.col("tool_key"), p["mode"], p["resource"], p["policy"]).alias("path"), p["prov"].alias("prov"), policy_provenance(p["gov"]).alias("policy_prov"),
        )

    return got.withColumn("deny_paths", F.array_sort(F.transform("tool_paths", told_of))).drop("tool_paths", "_held")


def deny_evidence(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(agent, tool_key, deny_paths): all paths of the given pairs, granted or not, in order."""
    wanted = pairs.select("agent", "tool_key").distinct().join(listed_deny_paths(graph), "tool_key")
    return with_evidence(wanted, graph.exceptions).select("agent", "tool_key", "deny_paths")
