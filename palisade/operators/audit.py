"""What the graph does not say but should: audits by anti joins and sorted sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.predicates import no_evidence, sorted_set
from palisade.operators import deny
from palisade.sources.model import PROV, Graph


def _tools(graph: Graph) -> DataFrame:
    return graph.tools.select(F.col("key").alias("tool_key"), F.col("name").alias("tool"), "server")


def callers(graph: Graph) -> DataFrame:
    """(tool_key, item): who may call a tool, a row per caller."""
    return graph.can_call.select("tool_key", F.col("agent").alias("item")).distinct()


def accesses(graph: Graph) -> DataFrame:
    """(tool_key, item): what a tool reads and writes, as `MODE uri`, a row per access."""
    return graph.data_access.select("tool_key", F.concat_ws(" ", "mode", "uri").alias("item")).distinct()


def governed(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(policy, item) of the resources and of the tools that policies govern, a row each."""
    on_resources = graph.governed_resource.select("policy", F.col("uri").alias("item")).distinct()
    return on_resources, graph.governed_tool.select("policy", F.col("tool_key").alias("item")).distinct()


def with_items(rows: DataFrame, key: str, items: dict[str, DataFrame], shown: str | None) -> DataFrame:
    """rows plus what belongs to them: sorted lists, counts named `<name>_count`, or nothing (shown: lists, counts, None).

    Only items of keys that rows hold are gathered. A list is as long as the
    graph makes it; counts, and the items themselves, have no row that grows.
    """
    if shown is None:
        return rows
    for name, each in items.items():
        asked = each.join(rows.select(key), key, "left_semi").groupBy(key)
        if shown == "counts":
            rows = rows.join(asked.agg(F.count("item").alias("_n")), key, "left").withColumn(f"{name}_count", F.coalesce("_n", F.lit(0))).drop("_n")
        else:
            rows = rows.join(asked.agg(sorted_set(F.col("item")).alias("_l")), key, "left").withColumn(name, F.coalesce("_l", F.array().cast("array<string>"))).drop("_l")
    return rows


def authored_keys(graph: Graph) -> DataFrame:
    """Tools that an authored edge names."""
    return graph.can_call.select("tool_key").union(graph.data_access.select("tool_key")).union(graph.governed_tool.select("tool_key")).distinct()


def unmapped_tools(graph: Graph, only_granted: bool = True, shown: str | None = "lists") -> DataFrame:
    """Tools without READS or WRITES, with their callers; by default only those someone may call."""
    rows = _tools(graph).join(graph.data_access.select("tool_key"), "tool_key", "left_anti")
    if only_granted:
        rows = rows.join(graph.can_call.select("tool_key"), "tool_key", "left_semi")
    return with_items(rows, "tool_key", {"granted_to": callers(graph)}, shown)


def orphan_policies(graph: Graph, shown: str | None = "lists") -> DataFrame:
    """Policies that no agent reaches by either route, with what they govern."""
    called = graph.can_call.select("tool_key").distinct()
    touched = graph.data_access.join(called, "tool_key", "left_semi").select("uri").distinct()
    reached = graph.governed_resource.join(touched, "uri", "left_semi").select("policy").union(graph.governed_tool.join(called, "tool_key", "left_semi").select("policy")).distinct()
    rows = graph.policies.select(F.col("id").alias("policy"), "effect", "scope").join(reached, "policy", "left_anti")
    on_resources, on_tools = governed(graph)
    return with_items(rows, "policy", {"governed_resources": on_resources, "governed_tools": on_tools}, shown)


def unbacked_edges(graph: Graph, include_grants: bool = False) -> DataFrame:
    """Authored edges without usable evidence; grants only on request."""

    def edges(df: DataFrame, kind, src_label: str, src: str, dst_label: str, dst: str) -> DataFrame:
        bare = df.filter(no_evidence(F.col("prov.evidence")))
        return bare.select(
            kind.alias("edge_type"), F.lit(src_label).alias("src_label"), F.col(src).alias("src"), F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst"),
            F.coalesce("prov.source", F.lit("operator_asserted")).alias("source"), F.coalesce("prov.confidence", F.lit("high")).alias("confidence"),
        )

    parts = [
        edges(graph.data_access, F.col("mode"), "Tool", "tool_key", "Resource", "uri"),
        edges(graph.governed_resource, F.lit("GOVERNED_BY"), "Resource", "uri", "Policy", "policy"),
        edges(graph.governed_tool, F.lit("GOVERNED_BY"), "Tool", "tool_key", "Policy", "policy"),
    ]
    if include_grants:
        parts.append(edges(graph.can_call, F.lit("CAN_CALL"), "Agent", "agent", "Tool", "tool_key"))
    return reduce(DataFrame.unionByName, parts)


def drifted_tools(graph: Graph, shown: str | None = "lists") -> DataFrame:
    """Tools that authored edges name but no server exposes."""
    rows = _tools(graph).join(graph.exposes.select("tool_key"), "tool_key", "left_anti").join(authored_keys(graph), "tool_key", "left_semi")
    return with_items(rows, "tool_key", {"granted_to": callers(graph), "data_access": accesses(graph)}, shown)


def annotation_provenance(exposes_evidence):
    """A server's claim about its own tool: crawled, medium, with the evidence of the EXPOSES edge."""
    return F.struct(F.lit("crawled").alias("source"), F.lit("medium").alias("confidence"), exposes_evidence.alias("evidence")).cast(PROV)


def _claimed(graph: Graph, hint: str) -> DataFrame:
    """Tools with a hint set, and the evidence of the EXPOSES edge (null when drifted)."""
    shown = graph.exposes.groupBy("tool_key").agg(F.min("prov.evidence").alias("exposes_evidence"))
    rows = graph.tools.filter(F.col(hint)).select(F.col("key").alias("tool_key"), F.col("name").alias("tool"), "server")
    return rows.join(shown, "tool_key", "left")


def destructive_unsafeguarded(graph: Graph, shown: str | None = "lists") -> DataFrame:
    """Tools that claim to be destructive and have no policy of any effect, on them or on what they touch."""
    touching = graph.data_access.join(graph.governed_resource.select("uri").distinct(), "uri", "left_semi").select("tool_key")
    rows = _claimed(graph, "destructive_hint").join(graph.governed_tool.select("tool_key"), "tool_key", "left_anti").join(touching, "tool_key", "left_anti")
    rows = with_items(rows, "tool_key", {"granted_to": callers(graph), "data_access": accesses(graph)}, shown)
    return rows.withColumns({"annotation_claim": F.lit("destructiveHint: true"), "annotation_prov": annotation_provenance(F.col("exposes_evidence"))}).drop("exposes_evidence")


def annotation_contradictions(graph: Graph) -> DataFrame:
    """WRITES edges of tools that claim to be read-only, with both provenances."""
    writes = graph.data_access.filter("mode = 'WRITES'").select("tool_key", F.col("uri").alias("resource"), "prov")
    rows = writes.join(_claimed(graph, "read_only_hint"), "tool_key")
    return rows.select(
        "tool_key", "tool", "server", "resource", F.lit("readOnlyHint: true").alias("annotation_claim"), annotation_provenance(F.col("exposes_evidence")).alias("annotation_prov"),
        F.concat(F.lit("WRITES "), F.col("resource")).alias("authored_claim"), F.col("prov").alias("authored_prov"),
    )


def findings(graph: Graph, include_grants: bool = False, shown: str | None = "lists") -> dict[str, DataFrame]:
    """The eight finding tables of a whole-graph audit, with lists, counts or neither (see with_items)."""
    paths = deny.classified_paths(graph)
    return {
        "unsafe_violations": paths.filter("classification = 'violation'"),
        "authorized_but_governed": paths.filter("classification = 'authorized_but_governed'"),
        "drifted_tools": drifted_tools(graph, shown),
        "unmapped_tools": unmapped_tools(graph, shown=shown),
        "unbacked_edges": unbacked_edges(graph, include_grants),
        "orphan_policies": orphan_policies(graph, shown),
        "destructive_unsafeguarded": destructive_unsafeguarded(graph, shown),
        "annotation_contradictions": annotation_contradictions(graph),
    }


BLOCKING = ("unsafe_violations", "drifted_tools")


#: What is summed up of a tool's rows to tell which findings name it.
_MARKS = ("tool", "read_only", "destructive", "shown", "called", "accessed", "writes", "authored", "guarded", "bare")


def _tool_findings() -> dict[str, Column]:
    """Counts of the findings that follow from a tool's own rows, over _tool_marks."""
    c, nameless = F.col, F.col("tool_key").isNull()  # a key that is null equals none
    return {
        "drifted_tools": F.sum(F.when(~nameless & (c("shown") == 0) & (c("authored") > 0), c("tool"))),
        "unmapped_tools": F.sum(F.when(~nameless & (c("accessed") == 0) & (c("called") > 0), c("tool"))),
        "unbacked_edges": F.sum("bare"),
        "destructive_unsafeguarded": F.sum(F.when(nameless | (c("guarded") == 0), c("destructive"))),
        "annotation_contradictions": F.sum(F.when(~nameless, c("writes") * c("read_only"))),
    }


def _tool_marks(graph: Graph, include_grants: bool) -> DataFrame:
    """(tool_key and _MARKS): how many of a tool's rows are what, by one shuffle of all of them."""
    c, yes = F.col, F.lit(True)
    bare = no_evidence(c("prov.evidence"))
    on_uri = graph.governed_resource.select("uri", F.lit(True).alias("_u")).distinct()

    def marked(df: DataFrame, key: Column, **marks: Column) -> DataFrame:
        return df.select(key.alias("tool_key"), *[F.coalesce(marks[m].cast("long"), F.lit(0)).alias(m) if m in marks else F.lit(0).cast("long").alias(m) for m in _MARKS])

    key = c("tool_key")
    parts = [
        marked(graph.tools, c("key"), tool=yes, read_only=c("read_only_hint"), destructive=c("destructive_hint")),
        marked(graph.exposes, key, shown=yes),
        marked(graph.can_call, key, called=yes, authored=yes, **({"bare": bare} if include_grants else {})),
        marked(graph.data_access.join(on_uri, "uri", "left"), key, accessed=yes, authored=yes, writes=c("mode") == "WRITES", guarded=c("_u"), bare=bare),
        marked(graph.governed_tool, key, authored=yes, guarded=yes, bare=bare),
        marked(graph.governed_resource, F.lit(None).cast("string"), bare=bare),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("tool_key").agg(*[F.sum(m).alias(m) for m in _MARKS])


def _listed(counts: dict[str, Column]) -> Column:
    """(finding, count) rows of named counts."""
    return F.explode(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*[F.coalesce(n, F.lit(0)) for n in counts.values()]))).alias("finding", "count")


def audit_report(graph: Graph, include_grants: bool = False) -> DataFrame:
    """(finding, count, blocking, status): status is fail on violations or drift, warn on any finding, else pass.

    The counts of findings() without their rows: both kinds of paths are
    counted in one pass over them, and what a tool's own rows tell in one pass
    over these, where a join for each finding would have the driver hold a
    broadcast table and a part of the plan for each.
    """
    counts = {"unsafe_violations": F.count_if(F.col("classification") == "violation"), "authorized_but_governed": F.count_if(F.col("classification") == "authorized_but_governed")}
    sides = [(deny.classified_paths(graph), counts), (_tool_marks(graph, include_grants), _tool_findings()), (orphan_policies(graph, None), {"orphan_policies": F.count("*")})]
    parts = [df.agg(*[n.alias(name) for name, n in counts.items()]).select(_listed({name: F.col(name) for name in counts})) for df, counts in sides]
    rows = reduce(DataFrame.unionByName, parts).withColumn("blocking", F.col("finding").isin(*BLOCKING) & (F.col("count") > 0))
    every = Window.partitionBy()  # one row per finding
    status = F.when(F.bool_or("blocking").over(every), "fail").when(F.bool_or(F.col("count") > 0).over(every), "warn").otherwise("pass")
    return rows.select("finding", "count", "blocking", status.alias("status"))


def graph_counts(graph: Graph) -> DataFrame:
    """(name, count) per crawled label and edge type, zero when absent."""
    parts = {"MCPServer": graph.servers, "Tool": graph.tools, "Resource": graph.resources, "EXPOSES": graph.exposes, "PROVIDES": graph.provides}
    return _counts(parts)


def governance_counts(graph: Graph) -> DataFrame:
    """(name, count) per authored label and edge type, zero when absent."""
    parts = {
        "Agent": graph.agents, "Policy": graph.policies, "ExpectedException": graph.exceptions, "CAN_CALL": graph.can_call,
        "READS": graph.data_access.filter("mode = 'READS'"), "WRITES": graph.data_access.filter("mode = 'WRITES'"),
        "GOVERNED_BY": graph.governed_resource.select("policy").union(graph.governed_tool.select("policy")),
    }
    return _counts(parts)


def _counts(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count") for name, df in parts.items()])
