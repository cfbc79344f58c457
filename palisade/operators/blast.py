"""What a change to a resource or a policy touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.predicates import short_name
from palisade.operators.scrub import display_resource
from palisade.sources.model import Graph


def dispatch(graph: Graph, nodes: DataFrame) -> DataFrame:
    """nodes(node, kind) plus `resolved`: resource, policy, ambiguous or not_found; an explicit kind decides."""
    r = graph.resources.select(F.col("uri").alias("node"), F.lit(True).alias("_r"))
    p = graph.policies.select(F.col("id").alias("node"), F.lit(True).alias("_p"))
    hit = nodes.join(r, "node", "left").join(p, "node", "left")
    is_r, is_p = F.coalesce("_r", F.lit(False)), F.coalesce("_p", F.lit(False))
    kind = (
        F.when(F.col("kind") == "resource", F.when(is_r, "resource"))
        .when(F.col("kind") == "policy", F.when(is_p, "policy"))
        .when(is_r & is_p, "ambiguous")
        .when(is_r, "resource")
        .when(is_p, "policy")
    )
    return hit.select(*nodes.columns, F.coalesce(kind, F.lit("not_found")).alias("resolved"))


def radius_path(agent: Column, tool: Column, mode: Column, resource: Column) -> Column:
    shown = display_resource(resource)
    called = F.format_string("(%s) -CAN_CALL-> (%s) -%s-> (%s)", agent, tool, mode, shown)
    return F.when(agent.isNotNull() & tool.isNotNull(), called).when(tool.isNotNull(), F.format_string("(%s) -%s-> (%s)", tool, mode, shown))


def of_resources(graph: Graph, resources: DataFrame | None = None) -> DataFrame:
    """(resource, tool_key, mode, agent, path): tools that touch a resource and who may call them, if anyone."""
    access = graph.data_access.select("tool_key", "mode", F.col("uri").alias("resource"))
    if resources is not None:
        access = access.join(resources.select("resource").distinct(), "resource", "left_semi")
    rows = access.join(graph.can_call.select("agent", "tool_key"), "tool_key", "left").distinct()
    return rows.select("resource", "tool_key", "mode", "agent", radius_path(F.col("agent"), short_name(F.col("tool_key")), F.col("mode"), F.col("resource")).alias("path"))


def of_policies(graph: Graph) -> DataFrame:
    """(policy, via, resource, tool_key, mode, agent, path): impact through resources and through tools."""
    callers = graph.can_call.select("agent", "tool_key")
    via_resource = graph.governed_resource.select("policy", "uri").join(graph.data_access.select("tool_key", "mode", "uri"), "uri").join(callers, "tool_key", "left")
    tool = short_name(F.col("tool_key"))
    one = via_resource.select("policy", F.lit("resource").alias("via"), F.col("uri").alias("resource"), "tool_key", "mode", "agent").distinct()
    one = one.withColumn("path", radius_path(F.col("agent"), tool, F.col("mode"), F.col("resource")))
    none = F.lit(None).cast("string")
    two = graph.governed_tool.select("policy", "tool_key").join(callers, "tool_key", "left").select("policy", F.lit("tool").alias("via"), none.alias("resource"), "tool_key", none.alias("mode"), "agent").distinct()
    two = two.withColumn("path", F.when(F.col("agent").isNotNull(), F.format_string("(%s) -CAN_CALL-> (%s) [GOVERNED_BY %s]", F.col("agent"), tool, display_resource(F.col("policy")))))
    return one.unionByName(two)
