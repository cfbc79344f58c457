"""Registered queries of the governance operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import predicates as P
from palisade.operators import audit, blast, deny, resolve, scrub, selector
from palisade.sources.lens import AskedLens, Lens, StoredLens, over_lens
from palisade.sources.snapshots import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, lens: bool = True, of: type[Lens] = StoredLens):
    """Register a function of a Lens under its name, with its SQL over the lens."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(of(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = over_lens(sql) if lens else sql
        return f

    return add


def joined(column: str, sep: str = ","):
    return F.array_join(column, sep).alias(column)


# ---- Governance reachability ---------------------------------------------------


@query("select agent, tool_key, mode, resource, policy, 'operator_asserted' as source, 'high' as confidence, evidence from deny where via = 'resource'")
def g1_deny_by_resource(x: Lens) -> DataFrame:
    return deny.deny_by_resource(x.graph).select("agent", "tool_key", "mode", "resource", "policy", "prov.*")


@query("select agent, tool_key, policy from deny where via = 'tool'")
def g2_deny_by_tool(x: Lens) -> DataFrame:
    return deny.deny_by_tool(x.graph).select("agent", "tool_key", "policy")


@query("select via, agent, tool_key, resource, policy, mode, classification = 'authorized_but_governed' as excepted from classified")
def g3_exception_match(x: Lens) -> DataFrame:
    return deny.match_exceptions(deny.deny_paths(x.graph), x.graph.exceptions).select("via", "agent", "tool_key", "resource", "policy", "mode", "excepted")


@query("select classification, via, count(*) as n, count(distinct agent) as agents from classified group by 1, 2")
def g4_classification(x: Lens) -> DataFrame:
    return deny.classified_paths(x.graph).groupBy("classification", "via").agg(F.count("*").alias("n"), F.countDistinct("agent").alias("agents"))


@query("select agent, tool_key, resource, policy, mode, exception_reason from classified where classification <> 'violation'")
def g5_exception_reason(x: Lens) -> DataFrame:
    return deny.classified_paths(x.graph).filter("classification <> 'violation'").select("agent", "tool_key", "resource", "policy", "mode", "exception_reason")


@query("select distinct tool_key, mode, resource, policy, path from classified")
def g6_evidence_path(x: Lens) -> DataFrame:
    return deny.classified_paths(x.graph).select("tool_key", "mode", "resource", "policy", "path").distinct()


@query("select tool_key, mode, uri, 'operator_asserted' as source, 'high' as confidence, evidence from data_access")
def g7_provenance_passthrough(x: Lens) -> DataFrame:
    return x.graph.data_access.select("tool_key", "mode", "uri", "prov.*")


@query("select distinct tool_key, mode, resource, policy, case when gov_evidence is not null then 'operator_asserted' end as source, gov_evidence as evidence from classified where via = 'resource'")
def g8_policy_provenance(x: Lens) -> DataFrame:
    rows = deny.classified_paths(x.graph).filter("via = 'resource'")
    return rows.select("tool_key", "mode", "resource", "policy", F.col("policy_prov.source").alias("source"), F.col("policy_prov.evidence").alias("evidence")).distinct()


@query(
    """, pairs as (select distinct agent, tool_key from observed),
  paths as (select p.agent, a.tool_key, a.uri as resource, g.policy from pairs p join data_access a using (tool_key) join governed_resource g using (uri) join policies q on q.id = g.policy and q.effect = 'DENY'
    union all select p.agent, g.tool_key, null, g.policy from pairs p join governed_tool g using (tool_key) join policies q on q.id = g.policy and q.effect = 'DENY')
  select agent, tool_key, count(*)::bigint as n_paths, min(resource) as first_resource from paths group by 1, 2""",
    of=AskedLens,
)
def g9_deny_evidence(x: AskedLens) -> DataFrame:
    got = deny.deny_evidence(x.graph_for(x.observed.select(F.col("tool_key").alias("ref"))), x.observed)
    return got.select("agent", "tool_key", F.size("deny_paths").cast("long").alias("n_paths"), F.array_min(F.transform("deny_paths", lambda p: p["resource"])).alias("first_resource"))


_CHECKED = "(select distinct agent, candidate as ref, tool_key, permitted, verdict, found, classification from features)"


@query(f"select agent, ref, true as agent_found, found, tool_key, permitted, verdict from {_CHECKED}", of=AskedLens)
def g10_check_access(x: AskedLens) -> DataFrame:
    return selector.check_access(x.asked_graph, x.candidates).select("agent", "ref", "agent_found", "found", "tool_key", "permitted", "verdict")


@query(f"select agent, ref, classification = 'authorized_but_governed' as all_authorized from {_CHECKED} where verdict = 'DENY'", of=AskedLens)
def g11_all_authorized(x: AskedLens) -> DataFrame:
    return selector.check_access(x.asked_graph, x.candidates).filter("verdict = 'DENY'").select("agent", "ref", "all_authorized")


@query("select id as agent, true as agent_found, count(c.agent) as count from agents a left join (select agent from classified where classification = 'violation') c on c.agent = a.id group by 1")
def g12_unsafe_tools(x: Lens) -> DataFrame:
    return deny.unsafe_tools(x.graph)


@query("select via, agent, tool_key, mode, resource, policy, classification, exception_reason, path from classified")
def g13_unsafe_tools_all_agents(x: Lens) -> DataFrame:
    return deny.classified_paths(x.graph).select("via", "agent", "tool_key", "mode", "resource", "policy", "classification", "exception_reason", "path")


@query(
    """, nodes as (select uri as node, null as kind from resources union all select id, null from policies union all select id, 'resource' from policies union all select distinct server, null from tools)
  select node, kind, case when kind = 'resource' then case when r.uri is not null then 'resource' else 'not_found' end when r.uri is not null and p.id is not null then 'ambiguous' when r.uri is not null then 'resource' when p.id is not null then 'policy' else 'not_found' end as resolved
  from nodes left join resources r on r.uri = node left join policies p on p.id = node"""
)
def g14_blast_dispatch(x: Lens) -> DataFrame:
    none = F.lit(None).cast("string").alias("kind")
    g = x.graph
    nodes = g.resources.select(F.col("uri").alias("node"), none).union(g.policies.select("id", none)).union(g.policies.select("id", F.lit("resource"))).union(g.servers.select("name", none))
    return blast.dispatch(g, nodes)


@query("select distinct uri as resource, a.tool_key, mode, agent from data_access a left join can_call c using (tool_key)")
def g15_blast_resource(x: Lens) -> DataFrame:
    return blast.of_resources(x.graph).drop("path")


_POLICY_IMPACT = """(select distinct policy, 'resource' as via, uri as resource, a.tool_key, a.mode, agent from governed_resource g join data_access a using (uri) left join can_call c on c.tool_key = a.tool_key
  union all select distinct policy, 'tool', null, g.tool_key, null, agent from governed_tool g left join can_call c using (tool_key))"""


@query(f"select policy, via, resource, tool_key, mode, agent from {_POLICY_IMPACT}")
def g16_blast_policy(x: Lens) -> DataFrame:
    return blast.of_policies(x.graph).drop("path")


@query(
    f"""select policy, via, tool_key, agent, resource, mode, case when via = 'tool' then case when agent is not null then '(' || agent || ') -CAN_CALL-> (' || split_part(tool_key, '::', 2) || ') [GOVERNED_BY ' || policy || ']' end
  when agent is not null then '(' || agent || ') -CAN_CALL-> (' || split_part(tool_key, '::', 2) || ') -' || mode || '-> (' || resource || ')' else '(' || split_part(tool_key, '::', 2) || ') -' || mode || '-> (' || resource || ')' end as path from {_POLICY_IMPACT}"""
)
def g17_radius_path(x: Lens) -> DataFrame:
    return blast.of_policies(x.graph)


# ---- Audits --------------------------------------------------------------------

_CALLERS = "(select tool_key, string_agg(distinct agent, ',' order by agent) as granted_to from can_call group by 1)"
_ACCESSES = "(select tool_key, string_agg(distinct mode || ' ' || uri, ',' order by mode || ' ' || uri) as data_access from data_access group by 1)"


@query(f"select t.tool_key, t.tool, t.server, granted_to from tools t join {_CALLERS} c using (tool_key) where tool_key not in (select tool_key from data_access)")
def a1_unmapped_tools(x: Lens) -> DataFrame:
    return audit.unmapped_tools(x.graph).withColumn("granted_to", joined("granted_to"))


@query(
    """, reached as (select policy from governed_resource g join data_access a using (uri) join can_call c using (tool_key) union select policy from governed_tool g join can_call c using (tool_key))
  select id as policy, effect, scope, coalesce((select string_agg(distinct uri, ',' order by uri) from governed_resource g where g.policy = id), '') as governed_resources, coalesce((select string_agg(distinct tool_key, ',' order by tool_key) from governed_tool g where g.policy = id), '') as governed_tools
  from policies where id not in (select policy from reached)"""
)
def a2_orphan_policies(x: Lens) -> DataFrame:
    return audit.orphan_policies(x.graph).withColumns({c: F.array_join(c, ",") for c in ("governed_resources", "governed_tools")})


_UNBACKED = """(select mode as edge_type, 'Tool' as src_label, tool_key as src, 'Resource' as dst_label, uri as dst from data_access where evidence is null
  union all select 'GOVERNED_BY', 'Resource', uri, 'Policy', policy from governed_resource where evidence is null union all select 'GOVERNED_BY', 'Tool', tool_key, 'Policy', policy from governed_tool where evidence is null
  union all select 'CAN_CALL', 'Agent', agent, 'Tool', tool_key from can_call where evidence is null)"""


@query(f"select *, 'operator_asserted' as source, 'high' as confidence from {_UNBACKED}")
def a3_unbacked_edges(x: Lens) -> DataFrame:
    return audit.unbacked_edges(x.graph, include_grants=True)


@query(f"select t.tool_key, t.tool, t.server, coalesce(granted_to, '') as granted_to, coalesce(data_access, '') as data_access from tools t semi join authored_keys using (tool_key) left join {_CALLERS} c using (tool_key) left join {_ACCESSES} a using (tool_key) where not exposed")
def a4_drifted_tools(x: Lens) -> DataFrame:
    return audit.drifted_tools(x.graph).withColumns({c: F.array_join(c, ",") for c in ("granted_to", "data_access")})


@query(
    f"""select t.tool_key, t.tool, t.server, coalesce(granted_to, '') as granted_to, coalesce(data_access, '') as data_access from tools t left join {_CALLERS} c using (tool_key) left join {_ACCESSES} a using (tool_key)
  where destructive_hint and tool_key not in (select tool_key from governed_tool) and tool_key not in (select tool_key from data_access join governed_resource using (uri))"""
)
def a5_destructive_unsafeguarded(x: Lens) -> DataFrame:
    rows = audit.destructive_unsafeguarded(x.graph).select("tool_key", "tool", "server", "granted_to", "data_access")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("granted_to", "data_access")})


@query("select tool_key, tool, server, uri as resource, 'WRITES ' || uri as authored_claim, evidence from data_access join tools using (tool_key) where mode = 'WRITES' and read_only_hint")
def a6_annotation_contradictions(x: Lens) -> DataFrame:
    return audit.annotation_contradictions(x.graph).select("tool_key", "tool", "server", "resource", "authored_claim", F.col("authored_prov.evidence").alias("evidence"))


@query("select distinct tool_key, 'crawled' as source, 'medium' as confidence, 'crawled from ' || server as evidence from data_access join tools using (tool_key) where mode = 'WRITES' and read_only_hint")
def a7_annotation_provenance(x: Lens) -> DataFrame:
    return audit.annotation_contradictions(x.graph).select("tool_key", "annotation_prov.*").distinct()


@query(
    f""", n as (select 'unsafe_violations' as finding, count(*) as count from classified where classification = 'violation' union all select 'authorized_but_governed', count(*) from classified where classification <> 'violation'
  union all select 'drifted_tools', count(*) from tools semi join authored_keys using (tool_key) where not exposed union all select 'unmapped_tools', count(*) from tools where tool_key in (select tool_key from can_call) and tool_key not in (select tool_key from data_access)
  union all select 'unbacked_edges', count(*) from {_UNBACKED} where edge_type <> 'CAN_CALL' union all select 'orphan_policies', count(*) from policies where id not in (select policy from governed_resource join data_access using (uri) join can_call using (tool_key)) and id not in (select policy from governed_tool join can_call using (tool_key))
  union all select 'destructive_unsafeguarded', count(*) from tools where destructive_hint and tool_key not in (select tool_key from governed_tool) and tool_key not in (select tool_key from data_access join governed_resource using (uri))
  union all select 'annotation_contradictions', count(*) from data_access join tools using (tool_key) where mode = 'WRITES' and read_only_hint)
  select finding, count, finding in ('unsafe_violations', 'drifted_tools') and count > 0 as blocking, case when bool_or(finding in ('unsafe_violations', 'drifted_tools') and count > 0) over () then 'fail' when bool_or(count > 0) over () then 'warn' else 'pass' end as status from n"""
)
def a8_audit_report(x: Lens) -> DataFrame:
    return audit.audit_report(x.graph)


@query("select c_name as agent, coalesce(string_agg(distinct uri, ',' order by uri), '') as resources from customer left join can_call on agent = c_name left join data_access using (tool_key) group by 1")
def a9_sorted_list_agg(x: Lens) -> DataFrame:
    rows = x.graph.agents.select(F.col("id").alias("agent")).join(x.graph.can_call, "agent", "left").join(x.graph.data_access.select("tool_key", "uri"), "tool_key", "left")
    return rows.groupBy("agent").agg(F.array_join(P.sorted_set(F.col("uri")), ",").alias("resources"))


@query("select 'MCPServer' as name, count(distinct server) as count from tools union all select 'Tool', count(*) from tools union all select 'Resource', count(*) from resources union all select 'EXPOSES', count(*) from exposes union all select 'PROVIDES', count(*) from provides")
def s14_graph_counts(x: Lens) -> DataFrame:
    return audit.graph_counts(x.graph)


@query(
    """select 'Agent' as name, count(*) as count from agents union all select 'Policy', count(*) from policies union all select 'ExpectedException', count(*) from exceptions union all select 'CAN_CALL', count(*) from can_call
  union all select 'READS', count(*) from data_access where mode = 'READS' union all select 'WRITES', count(*) from data_access where mode = 'WRITES' union all select 'GOVERNED_BY', (select count(*) from governed_resource) + (select count(*) from governed_tool)"""
)
def s15_governance_counts(x: Lens) -> DataFrame:
    return audit.governance_counts(x.graph)


# ---- Reference resolution --------------------------------------------------------

_REFS = "(select distinct ref from candidates)"


@query(f"select r.ref, coalesce(array_to_string(keys, ','), '') as keys from {_REFS} r left join resolved using (ref)", of=AskedLens)
def r1_resolve_refs(x: AskedLens) -> DataFrame:
    return resolve.resolve_refs(x.asked_graph.tools, x.candidates).select("ref", joined("keys"))


@query(f"select r.ref, case when len(keys) = 1 then keys[1] end as tool_key, case when keys is null then 'not found' when len(keys) > 1 then 'ambiguous' end as problem from {_REFS} r left join resolved using (ref)", of=AskedLens)
def r2_unique_resolution(x: AskedLens) -> DataFrame:
    return resolve.unique_resolution(x.asked_graph.tools, x.candidates)


@query("select agent, ref, case when contains(ref, '::') or keys is null then ref when len(keys) = 1 then keys[1] end as tool_key, case when not contains(ref, '::') and len(keys) > 1 then 'AMBIGUOUS_GRANT' end as status from candidates left join resolved using (ref)", of=AskedLens)
def r3_resolve_grants(x: AskedLens) -> DataFrame:
    return resolve.resolve_grants(x.asked_graph.tools, x.candidates.select("agent", "ref"))


@query("with v as (select distinct url as ref from pages union select s_name || '::part-' || s_suppkey from supplier union select 'store:' || p_brand from part) select ref, regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') and not regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*::') as is_resource from v", lens=False)
def r4_is_resource_ref(x: Lens) -> DataFrame:
    refs = x.table("pages").select(F.col("url").alias("ref")).union(x.table("supplier").select(F.format_string("%s::part-%d", "s_name", "s_suppkey"))).union(x.table("part").select(F.concat(F.lit("store:"), F.col("p_brand"))))
    return refs.distinct().select("ref", P.is_resource_ref(F.col("ref")).alias("is_resource"))


@query(
    r"""with p as (select distinct url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(.*)$', 1) as t from pages),
  c as (select url as uri, s || '://' || regexp_replace(lower(h), case s when 'http' then ':(80)?$' else ':(443)?$' end, '') || case when p = '' then '/' else p end || t as canonical from p)
  select uri, canonical, uri <> canonical as changed, count(*) over (partition by canonical) > 1 as collides from c""",
    lens=False,
)
def r5_canonical_uri(x: Lens) -> DataFrame:
    return resolve.uri_report(x.table("pages").select(F.col("url").alias("uri")))


@query(", a as (select id as agent from agents union all select distinct server from tools) select agent, agent in (select id from agents) as found from a")
def r6_agent_present(x: Lens) -> DataFrame:
    names = x.graph.agents.select(F.col("id").alias("agent")).union(x.graph.servers.select("name"))
    return resolve.agent_present(x.graph, names)


@query("select tool_key, tool as short_name from tools")
def r7_tool_short_name(x: Lens) -> DataFrame:
    return x.graph.tools.select(F.col("key").alias("tool_key"), P.short_name(F.col("key")).alias("short_name"))


@query("select agent, tool_key, evidence is not null as has_evidence from can_call")
def r8_has_evidence(x: Lens) -> DataFrame:
    return x.graph.can_call.select("agent", "tool_key", (~P.no_evidence(F.col("prov.evidence"))).alias("has_evidence"))


# ---- Selector ----------------------------------------------------------------------


@query("select o.agent, tool_key, f.is_drifted, f.is_unmapped, f.has_unbacked_edges, f.read_only_hint, f.destructive_hint, c.agent is not null as permitted from observed o join facts f using (tool_key) left join can_call c on c.agent = o.agent and c.tool_key = o.tool_key", of=AskedLens)
def f1_tool_facts(x: AskedLens) -> DataFrame:
    return selector.tool_facts(x.graph_for(x.observed.select(F.col("tool_key").alias("ref"))), x.observed).select("agent", "tool_key", "is_drifted", "is_unmapped", "has_unbacked_edges", "read_only_hint", "destructive_hint", "permitted")


@query("select agent, tool_key, case when violation then 'violation' else 'authorized_but_governed' end as classification from worst semi join can_call using (agent, tool_key)")
def f2_worst_classification(x: Lens) -> DataFrame:
    got = deny.deny_evidence(x.graph, x.graph.can_call)
    return got.select("agent", "tool_key", selector.worst_classification(F.col("deny_paths")).alias("classification"))


_FEATURES = "agent, pos, candidate, tool_key, found, ambiguous, permitted, verdict, classification, is_drifted, is_unmapped, has_unbacked_edges, risk_score"


@query(f"select {_FEATURES} from scored", of=AskedLens)
def f3_rank_features(x: AskedLens) -> DataFrame:
    return selector.rank_features(x.asked_graph, x.candidates).select(*_FEATURES.split(", "))


@query("select risk_score, count(*) as n from scored group by 1", of=AskedLens)
def f4_risk_score(x: AskedLens) -> DataFrame:
    return selector.rank_features(x.asked_graph, x.candidates).groupBy("risk_score").agg(F.count("*").alias("n"))


@query("select agent, pos, array_to_string(reasons, ',') as reasons from scored", of=AskedLens)
def f5_applicable_reasons(x: AskedLens) -> DataFrame:
    return selector.rank_features(x.asked_graph, x.candidates).select("agent", "pos", joined("reasons"))


_REASON = "list_filter(reasons, lambda x: list_contains({}, x))[1]"


@query(
    " union all ".join(f"select '{p}' as profile, agent, pos, tool_key, {_REASON.format(list(rs))} as reason from scored" for p, rs in selector.PROFILES.items()),
    of=AskedLens,
)
def f6_profile_filter(x: AskedLens) -> DataFrame:
    # Written once for the three profiles; a union of parts that are dealt alike also failed where Spark dealt one of them anew as it ran.
    features = stored(selector.rank_features(x.asked_graph, x.candidates).select("agent", "pos", "tool_key", "deny_paths", "reasons"))
    parts = [selector.filter_features(features, p).select("profile", "agent", "pos", "tool_key", "reason") for p in selector.PROFILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ELIGIBLE = f"(select *, {_REASON.format(list(selector.PROFILES['strict']))} as reason from scored)"


@query(f"select agent, tool_key, min(pos) as pos from {_ELIGIBLE} where reason is null group by 1, 2", of=AskedLens)
def f7_eligible_once(x: AskedLens) -> DataFrame:
    return selector.eligible_tools(x.asked_graph, x.candidates).filter("listed").select("agent", "tool_key", "pos")


@query(f"select agent, count(distinct tool_key) filter (where reason is null) as eligible, count(*) filter (where reason is not null) as rejected from {_ELIGIBLE} group by 1", of=AskedLens)
def f8_eligible_tools(x: AskedLens) -> DataFrame:
    got = selector.eligible_tools(x.asked_graph, x.candidates)
    return got.groupBy("agent").agg(F.count_if("listed").alias("eligible"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


@query(
    f""", e as (select distinct agent, candidate as ref, tool_key, case when reason is null then 'eligible' else 'rejected' end as decision, risk_score, found, ambiguous, permitted, is_drifted, is_unmapped, has_unbacked_edges, (classification is not null)::int as denied, read_only_hint, destructive_hint from {_ELIGIBLE})
  select agent, ref, tool_key, decision, risk_score, case when not found then 'The graph has no tool called ''' || ref || '''.' when ambiguous then 'Several tools have this name: ' || (select array_to_string(keys, ', ') from resolved r where r.ref = e.ref) || '. None is chosen; name one as server::tool.'
    when permitted then 'The agent holds a grant for this tool.' else 'The agent holds no grant for this tool.' end as first_sentence from e""",
    of=AskedLens,
)
def f9_selection_explain(x: AskedLens) -> DataFrame:
    got = selector.selection_explain(x.asked_graph, x.candidates)
    return got.select("agent", "ref", "tool_key", "decision", "risk_score", F.get("sentences", F.lit(0)).alias("first_sentence"))
