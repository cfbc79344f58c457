"""Governance manifests: checks that reject one, applying one, and its digest.

A manifest is five tables with their position `seq`: agents(id), policies(id,
effect, scope, description), grants(agent, ref, granted_by, prov),
data_access(ref, mode, resource, prov), bindings(field, node, policy, prov)
and exceptions(agent, ref, policy, resource, reason).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.predicates import is_resource_ref
from palisade.operators.crawl import last_of
from palisade.operators.resolve import canonical_uri, unique_resolution
from palisade.operators.scrub import is_credential_identity
from palisade.sources.model import PROV, Graph
from palisade.sources.schema import Either, Fields, Items, Mapping, Text, checked
from palisade.sources.snapshots import cut, stored

WARNING = "code string, subject string, message string"
#: Closed value sets. Fixed values of the manifest contract.
MODES, EFFECTS = ("READS", "WRITES"), ("ALLOW", "DENY")
SOURCES, CONFIDENCES = ("crawled", "operator_asserted", "inferred"), ("high", "medium", "low")
FIELDS = ("governed_by", "governed_tools", "governed_resources")


@dataclass(frozen=True)
class Manifest:
    agents: DataFrame
    policies: DataFrame
    grants: DataFrame
    data_access: DataFrame
    bindings: DataFrame
    exceptions: DataFrame

    def with_tables(self, **tables: DataFrame) -> Manifest:
        return replace(self, **tables)


def default_prov(prov: Column) -> Column:
    """Missing provenance is operator_asserted, high, without evidence; so is what a given one leaves out."""
    part = lambda name, plain: F.coalesce(prov.getField(name), F.lit(plain)).alias(name)
    return F.struct(part("source", "operator_asserted"), part("confidence", "high"), prov.getField("evidence").alias("evidence")).cast(PROV)


_CLEAN = Text(checks=((is_credential_identity, "must not hold a credential"),))
_PROVENANCE = Fields({"source": Text(values=SOURCES), "confidence": Text(values=CONFIDENCES), "evidence": Text()}, nullable=("evidence",), closed=True)
_BINDING = Fields({"policy": _CLEAN, "provenance": _PROVENANCE}, required=("policy",), nullable=("provenance",), closed=True)
#: A list under a free name; each item is a bare policy id or an object with provenance.
_BOUND = Mapping(Items(Either(_CLEAN, _BINDING)))
_BOUND_TOOLS = Mapping(_BOUND.of, names=((is_credential_identity, "has a name that must not hold a credential"),))
MANIFEST_RULE = Fields(
    {
        "agents": Items(_CLEAN),
        "policies": Items(Fields({"id": _CLEAN, "effect": Text(values=EFFECTS), "scope": Text(), "description": Text()}, required=("id", "effect"), nullable=("scope", "description"), closed=True)),
        "grants": Items(Fields({"agent": _CLEAN, "tool": _CLEAN, "granted_by": _CLEAN, "provenance": _PROVENANCE}, required=("agent", "tool"), nullable=("granted_by", "provenance"), closed=True)),
        "data_access": Items(Fields({"tool": _CLEAN, "resource": Text(), "mode": Text(values=MODES), "provenance": _PROVENANCE}, required=("tool", "resource", "mode"), nullable=("provenance",), closed=True)),
        "governed_by": _BOUND,
        "governed_tools": _BOUND_TOOLS,
        "governed_resources": _BOUND,
        "expected_exceptions": Items(Fields({"agent": _CLEAN, "tool": _CLEAN, "policy": _CLEAN, "resource": Text(), "reason": Text()}, required=("agent", "tool", "policy"), nullable=("resource", "reason"), closed=True)),
    },
    closed=True,
)
_PROV = "provenance:struct<source:string,confidence:string,evidence:string>"
_LISTS = {
    "agents": "array<string>",
    "policies": "array<struct<id:string,effect:string,scope:string,description:string>>",
    "grants": f"array<struct<agent:string,tool:string,granted_by:string,{_PROV}>>",
    "data_access": f"array<struct<tool:string,resource:string,mode:string,{_PROV}>>",
    **dict.fromkeys(FIELDS, "map<string,array<variant>>"),
    "expected_exceptions": "array<struct<agent:string,tool:string,policy:string,resource:string,reason:string>>",
}


def read_manifests(lines: DataFrame) -> tuple[Manifest, DataFrame]:
    """lines(value, ...) of manifests as JSON -> (Manifest, refused lines with `problem`); seq is the position in each list.

    A bound policy is a bare id or an object. Unknown fields, wrong types,
    values outside the closed sets and credentials in names refuse the whole
    manifest; the problem tells the place, an entry of free name by number.
    """
    # Checked and taken apart in one pass, and written by columns: each of the tables reads its own list.
    fine = F.col("problem").isNull()
    lists = F.struct(*[F.when(fine, F.try_variant_get("doc", f"$.{name}", kind)).alias(name) for name, kind in _LISTS.items()])
    others = [c for c in lines.columns if c not in ("value", "doc", "problem", "_lists")]
    got = stored(checked(lines, MANIFEST_RULE).select(*others, F.when(~fine, F.col("value")).alias("value"), "problem", lists.alias("_lists")))
    parsed = got.filter("problem is null").select("_lists.*")

    def rows(column: str) -> DataFrame:
        return parsed.select(F.posexplode(F.col(column)).alias("seq", "r")).select(F.col("seq").cast("long").alias("seq"), "r.*" if column != "agents" else F.col("r").alias("id"))

    bindings = []
    for f in FIELDS:
        each = parsed.select(F.explode(F.map_entries(f)).alias("e")).select(F.lit(f).alias("field"), F.col("e.key").alias("node"), F.posexplode("e.value").alias("seq", "b"))
        bare = F.when(F.schema_of_variant("b") == "STRING", F.try_variant_get("b", "$", "string"))
        policy = F.coalesce(bare, F.try_variant_get("b", "$.policy", "string"))
        prov = F.try_variant_get("b", "$.provenance", _PROV.split(":", 1)[1])
        bindings.append(each.select("field", "node", F.col("seq").cast("long").alias("seq"), policy.alias("policy"), default_prov(prov).alias("prov")))
    grants, access, exc = rows("grants"), rows("data_access"), rows("expected_exceptions")
    made = Manifest(
        agents=rows("agents"),
        policies=rows("policies"),
        grants=grants.select("seq", "agent", F.col("tool").alias("ref"), "granted_by", default_prov(F.col("provenance")).alias("prov")),
        data_access=access.select("seq", F.col("tool").alias("ref"), "mode", "resource", default_prov(F.col("provenance")).alias("prov")),
        bindings=reduce(DataFrame.unionByName, bindings),
        exceptions=exc.select("seq", "agent", F.col("tool").alias("ref"), "policy", "resource", "reason"),
    )
    return made, got.filter("problem is not null").drop("_lists")


def warning(rows: DataFrame, code: str, subject: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), subject.alias("subject"), message.alias("message"))


def _text(pattern: str, *columns) -> Column:
    return F.format_string(pattern, *columns)


def known_agents(m: Manifest) -> DataFrame:
    """Declared and granted agents."""
    return m.agents.select(F.col("id").alias("agent")).union(m.grants.select("agent")).distinct()


def duplicate_policies(m: Manifest) -> DataFrame:
    """(id, n) of policies that are defined more than once."""
    return m.policies.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


@dataclass(frozen=True)
class Resolved:
    """A manifest against a catalog: tables with tool keys, canonical uris and binding kinds."""

    grants: DataFrame
    data_access: DataFrame
    bindings: DataFrame
    exceptions: DataFrame


def resolve_manifest(m: Manifest, tools: DataFrame) -> Resolved:
    """Attach tool_key, problem, uri, and kind (resource or tool) to each row."""
    # Each table looks up its own references: whoever reads one table does not resolve those of the others.
    keyed = lambda df: df.join(unique_resolution(tools, df), "ref", "left")
    kind = F.when(F.col("field") == "governed_tools", "tool").when(F.col("field") == "governed_resources", "resource").when(is_resource_ref(F.col("node")), "resource").otherwise("tool")
    nodes = unique_resolution(tools, m.bindings.select(F.col("node").alias("ref"))).withColumnRenamed("ref", "node")
    bound = m.bindings.withColumn("kind", kind).join(nodes, "node", "left")
    target = F.when(F.col("kind") == "resource", canonical_uri(F.col("node"))).otherwise(F.col("tool_key"))
    return Resolved(
        grants=keyed(m.grants),
        data_access=keyed(m.data_access).withColumn("uri", canonical_uri(F.col("resource"))),
        bindings=bound.withColumn("target", target),
        exceptions=keyed(m.exceptions).withColumn("uri", canonical_uri(F.col("resource"))),
    )


def field_checks(m: Manifest) -> DataFrame:
    """Closed values, required fields, `::` in names and credential-shaped identities."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    ids = m.agents.select("id", F.lit("agent").alias("what")).union(m.policies.select("id", F.lit("policy"))).union(m.grants.select("agent", F.lit("grant agent"))).union(m.grants.select("ref", F.lit("grant tool")))
    parts = [
        warning(ids.filter(blank(F.col("id"))), "MISSING", F.col("what"), _text("%s without a name", "what")),
        warning(ids.filter(is_credential_identity(F.col("id"))), "CREDENTIAL", F.col("what"), _text("%s looks like a credential", "what")),
        warning(ids.filter("what = 'agent' and id like '%::%'"), "SEPARATOR", F.col("what"), _text("%s holds '::'", "what")),
        warning(m.policies.filter(~F.coalesce(F.col("effect").isin(*EFFECTS), F.lit(False))), "EFFECT", F.col("id"), _text("policy '%s' has an unknown effect", "id")),
        warning(m.data_access.filter(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))), "MODE", F.col("ref"), _text("data access of '%s' has an unknown mode", "ref")),
    ]
    provs = m.grants.select("prov").union(m.data_access.select("prov")).union(m.bindings.select("prov"))
    odd = ~F.col("prov.source").isin(*SOURCES) | ~F.col("prov.confidence").isin(*CONFIDENCES)
    parts.append(warning(provs.filter(odd), "PROVENANCE", F.col("prov.source"), F.lit("unknown source or confidence")))
    return reduce(DataFrame.unionByName, parts)


def binding_checks(m: Manifest, r: Resolved) -> DataFrame:
    """Bindings: kind mix-ups, undefined policies, unknown tools, the same binding in two fields."""
    b = r.bindings
    free = b.filter("field = 'governed_by'")
    uris = r.data_access.select("uri").union(r.exceptions.filter("uri is not null").select("uri")).distinct()
    also_tool = free.filter("kind = 'resource' and (tool_key is not null or problem = 'ambiguous')")
    also_resource = free.filter("kind = 'tool'").join(uris, canonical_uri(F.col("node")) == F.col("uri"), "left_semi")
    undefined = b.join(m.policies.select(F.col("id").alias("policy")), "policy", "left_anti")
    lost = b.filter("kind = 'tool' and problem is not null")
    twice = b.filter("target is not null").groupBy("kind", "target", "policy").agg(F.countDistinct("field").alias("n")).filter("n > 1")
    return reduce(
        DataFrame.unionByName,
        [
            warning(also_tool, "RESOURCE_IS_TOOL", F.col("node"), _text("'%s' looks like a resource but names a tool", "node")),
            warning(also_resource, "TOOL_IS_RESOURCE", F.col("node"), _text("'%s' looks like a tool but is used as a resource", "node")),
            warning(undefined, "UNDEFINED_POLICY", F.col("policy"), _text("'%s' is bound to undefined policy '%s'", "node", "policy")),
            warning(lost, "GOVERNED_TOOL", F.col("node"), _text("governed tool '%s': %s", "node", "problem")),
            warning(twice, "BOUND_TWICE", F.col("target"), _text("'%s' is bound to '%s' in two fields", "target", "policy")),
        ],
    )


def exception_flags(m: Manifest, r: Resolved) -> DataFrame:
    """exceptions plus `code` of the first failing check, null when all hold."""
    e = r.exceptions
    agents = m.agents.select(F.col("id").alias("agent"), F.lit(True).alias("_agent")).distinct()
    policies = last_of(m.policies, ["id"]).select(F.col("id").alias("policy"), "effect", F.lit(True).alias("_policy"))
    grants = r.grants.filter("tool_key is not null").select("agent", "tool_key", F.lit(True).alias("_grant")).distinct()
    access = r.data_access.filter("tool_key is not null").select("tool_key", "uri").distinct()
    on_uri = r.bindings.filter("kind = 'resource'").select(F.col("target").alias("uri"), "policy").distinct()
    on_tool = r.bindings.filter("kind = 'tool' and tool_key is not null").select("tool_key", "policy", F.lit(True).alias("_direct")).distinct()
    through = access.join(on_uri, "uri").select("tool_key", "policy", F.lit(True).alias("_through")).distinct()
    got = e.join(agents, "agent", "left").join(policies, "policy", "left").join(grants, ["agent", "tool_key"], "left")
    got = got.join(access.withColumn("_access", F.lit(True)), ["tool_key", "uri"], "left").join(on_uri.withColumn("_bound", F.lit(True)), ["uri", "policy"], "left")
    got = got.join(through, ["tool_key", "policy"], "left").join(on_tool, ["tool_key", "policy"], "left")
    special = F.col("uri").isNotNull()
    code = (
        F.when(F.col("_agent").isNull(), "EXCEPTION_AGENT")
        .when(F.col("_policy").isNull(), "EXCEPTION_POLICY")
        .when(F.col("effect") == "ALLOW", "EXCEPTION_ALLOW")
        .when(F.col("problem").isNotNull(), "EXCEPTION_TOOL")
        .when(F.col("_grant").isNull(), "EXCEPTION_GRANT")
        .when(special & F.col("_access").isNull(), "EXCEPTION_ACCESS")
        .when(special & F.col("_bound").isNull(), "EXCEPTION_BINDING")
        .when(~special & F.col("_through").isNull() & F.col("_direct").isNull(), "EXCEPTION_PATH")
    )
    return got.select(*e.columns, code.alias("code"))


def referenced_keys(r: Resolved) -> DataFrame:
    keys = [r.grants, r.data_access, r.exceptions]
    every = reduce(DataFrame.union, [k.select("tool_key") for k in keys]).union(r.bindings.filter("kind = 'tool'").select("tool_key"))
    return every.filter("tool_key is not null").distinct()


def drift_notices(r: Resolved, exposes: DataFrame) -> DataFrame:
    """Referenced tools that no server exposes."""
    lost = referenced_keys(r).join(exposes.select("tool_key"), "tool_key", "left_anti")
    return warning(lost, "DRIFTED", F.col("tool_key"), _text("tool '%s' is not exposed by any server", "tool_key"))


def check_manifest(m: Manifest, graph: Graph, strict_drift: bool = False) -> tuple[DataFrame, DataFrame]:
    """(warnings, notices): any warning rejects the whole manifest."""
    r = resolve_manifest(m, graph.tools)
    bad = lambda df, code, what: warning(df.filter("problem is not null"), code, F.col("ref"), _text(f"{what} '%s': %s", "ref", "problem"))
    flagged = exception_flags(m, r).filter("code is not null")
    warnings = [
        field_checks(m),
        warning(duplicate_policies(m), "DUPLICATE_POLICY", F.col("id"), _text("policy '%s' is defined more than once", "id")),
        bad(r.grants, "GRANT_TOOL", "grant of"),
        bad(r.data_access, "ACCESS_TOOL", "data access of"),
        binding_checks(m, r),
        flagged.select("code", F.col("ref").alias("subject"), _text("exception of '%s' on '%s' fails: %s", "agent", "ref", "code").alias("message")),
    ]
    drift = drift_notices(r, graph.exposes)
    if strict_drift:
        return reduce(DataFrame.unionByName, [*warnings, drift]), drift.limit(0)
    return reduce(DataFrame.unionByName, warnings), drift


def apply_manifest(m: Manifest, graph: Graph) -> Graph:
    """The graph with the authored part replaced by the manifest; the last entry of a key wins.

    Agents and policies follow the manifest; resources and tools that are left
    without any edge go; exceptions are not edges.
    """
    r = resolve_manifest(m, graph.tools)
    calls = last_of(r.grants.filter("tool_key is not null"), ["agent", "tool_key"]).select("agent", "tool_key", "granted_by", "prov")
    access = last_of(r.data_access.filter("tool_key is not null"), ["tool_key", "mode", "uri"]).select("tool_key", "mode", "uri", "prov")
    on_uri = last_of(r.bindings.filter("kind = 'resource'"), ["target", "policy"]).select(F.col("target").alias("uri"), "policy", "prov")
    on_tool = last_of(r.bindings.filter("kind = 'tool' and tool_key is not null"), ["tool_key", "policy"]).select("tool_key", "policy", "prov")
    exc = last_of(r.exceptions, ["agent", "tool_key", "uri", "policy"]).select("agent", "tool_key", F.col("uri").alias("resource"), "policy", "reason")
    none = F.lit(None).cast("string")
    named = access.select("uri").union(on_uri.select("uri")).distinct()
    added = named.join(graph.resources.select("uri"), "uri", "left_anti").select("uri", none.alias("name"), none.alias("mime_type"), none.alias("description"))
    held = graph.provides.select("uri").union(named).distinct()
    used = graph.exposes.select("tool_key").union(calls.select("tool_key")).union(access.select("tool_key")).union(on_tool.select("tool_key")).distinct()
    return graph.with_tables(
        agents=known_agents(m).select(F.col("agent").alias("id")),
        policies=last_of(m.policies, ["id"]).select("id", "effect", "scope", "description"),
        exceptions=exc,
        can_call=calls,
        data_access=access,
        governed_resource=on_uri,
        governed_tool=on_tool,
        resources=graph.resources.unionByName(added).join(held, "uri", "left_semi"),
        tools=graph.tools.join(used.select(F.col("tool_key").alias("key")), "key", "left_semi").select(*graph.tools.columns),
    )


def ingest(m: Manifest, graph: Graph, strict_drift: bool = False) -> tuple[Graph, DataFrame, DataFrame, bool]:
    """(graph, warnings, notices, applied): nothing changes when there is a warning."""
    warnings, notices = check_manifest(m, graph, strict_drift)
    # Whether there are any is asked here, and which by the caller.
    warnings = cut(warnings)
    applied = warnings.isEmpty()
    return (apply_manifest(m, graph) if applied else graph), warnings, notices, applied


def exception_key(agent: Column, tool_key: Column, resource: Column, policy: Column) -> Column:
    return F.sha2(F.to_json(F.array(agent, tool_key, resource, policy)), 256)


def sorted_digest(hashes: DataFrame) -> DataFrame:
    """(digest, n) of a table of row digests h: SHA-256 over all of them in order.

    A tree, so that no task holds them all: digests that begin with the same
    six hex digits are sorted and hashed, then groups that begin with the same
    three, then the 4,096 of those.
    """

    def hashed(value: str, order: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        return F.sha2(F.array_join(F.transform(rows, lambda r: r["v"]), ""), 256)

    fine = hashes.groupBy(F.substring("h", 1, 6).alias("p")).agg(hashed("h", "h").alias("d"), F.count("*").alias("n"))
    coarse = fine.groupBy(F.substring("p", 1, 3).alias("q")).agg(hashed("d", "p").alias("d"), F.sum("n").alias("n"))
    return coarse.agg(hashed("d", "q").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def governance_digest(m: Manifest) -> DataFrame:
    """(digest, rows): SHA-256 over the sorted digests of the rows of all tables; list order counts through seq."""
    rows = []
    for name in ("agents", "policies", "grants", "data_access", "bindings", "exceptions"):
        df = getattr(m, name)
        text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
        rows.append(df.select(F.sha2(F.concat(F.lit(name + ":"), text), 256).alias("h")))
    return sorted_digest(reduce(DataFrame.union, rows)).withColumnRenamed("n", "rows")
