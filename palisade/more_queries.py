"""Registered queries of crawl intake, manifests and their diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import crawl, diff, manifest
from palisade.queries import query
from palisade.sources.lens import AFTER_SQL, CRAWL_SQL, REORGANISED_SQL, Lens
from palisade.sources.model import SCHEMAS, Graph

# ---- Crawl reconciliation ---------------------------------------------------------


def crawled_graph(x: Lens) -> Graph:
    return crawl.apply_crawl(x.graph, *x.second_crawl)


@query(CRAWL_SQL + "select server as name, '2' as version from crawled union all select distinct server, null from tools anti join crawled using (server)")
def k1_upsert_servers(x: Lens) -> DataFrame:
    return crawl.upsert_servers(x.graph.servers, x.second_crawl[0]).select("name", "version")


@query(CRAWL_SQL + "select tool_key as key, tool as name, server, read_only_hint, null::boolean as destructive_hint from listed union all select tool_key, tool, server, read_only_hint, destructive_hint from tools anti join listed using (tool_key)")
def k2_upsert_tools(x: Lens) -> DataFrame:
    return crawl.upsert_tools(x.graph.tools, x.second_crawl[1]).select("key", "name", "server", "read_only_hint", "destructive_hint")


@query(
    """, shown as (select s_name as server, uri, min(p_partkey) as part, cast(right(s_name, 4) as int) % 17 as crawl from (select li.*, l_partkey as p_partkey from li) where p_size > 20 group by 1, 2, 4),
  placed as (select *, 'of ' || server as said from shown),
  told as (select uri, arg_max(said, (crawl, part, said)) as said from placed group by 1)
  select uri, said as name, 'listed' as description from told union all select uri, null, null from resources anti join told using (uri)"""
)
def k3_upsert_resources(x: Lens) -> DataFrame:
    """Seventeen crawls list resources that many servers share: the last crawl's fields stay, of the last position there."""
    part = x.lines.filter("p_size > 20").groupBy(F.col("s_name").alias("server"), "uri").agg(F.min("l_partkey").alias("seq"))
    listed = part.select("uri", F.concat(F.lit("of "), F.col("server")).alias("name"), F.lit(None).cast("string").alias("mime_type"), F.lit("listed").alias("description"), (F.right("server", F.lit(4)).cast("int") % 17).alias("crawl"), "seq")
    return crawl.upsert_resources(x.graph.resources, listed).select("uri", "name", "description")


@query(CRAWL_SQL + "select server, tool_key, evidence from exposes anti join crawled using (server) union all select server, tool_key, 'crawled from ' || server from listed")
def k4_drop_stale_exposes(x: Lens) -> DataFrame:
    servers, tools, _ = x.second_crawl
    listed = tools.select(F.col("key").alias("tool_key"), "server")
    return crawl.drop_stale_edges(x.graph.exposes, servers, listed, "tool_key").select("server", "tool_key", "prov.evidence")


def _unlisted(x: Lens) -> DataFrame:
    servers, tools, _ = x.second_crawl
    return crawl.unlisted_tools(x.graph, servers, tools.select(F.col("key").alias("tool_key")))


@query(CRAWL_SQL + "select tool_key as key, case when u.tool_key is null then read_only_hint end as read_only_hint, case when u.tool_key is null then destructive_hint end as destructive_hint from tools left join unlisted u using (tool_key)")
def k5_clear_stale_hints(x: Lens) -> DataFrame:
    return crawl.clear_stale_hints(x.graph.tools, _unlisted(x)).select("key", "read_only_hint", "destructive_hint")


@query(CRAWL_SQL + "select tool_key from removed")
def k6_drop_ungoverned_tools(x: Lens) -> DataFrame:
    return crawl.drop_ungoverned(x.graph, _unlisted(x)).select("tool_key")


@query(CRAWL_SQL + "select tool_key, 'tool ''' || tool_key || ''' is no longer exposed by ''' || server || ''' but keeps its authored edges' as message from unlisted semi join authored_keys using (tool_key)")
def k7_kept_tool_warnings(x: Lens) -> DataFrame:
    return crawl.kept_warnings(x.graph, _unlisted(x))


@query(CRAWL_SQL + "select uri from resources anti join orphaned using (uri)")
def k8_drop_stale_provides(x: Lens) -> DataFrame:
    return crawled_graph(x).resources.select("uri")


_SPECS = "(select case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then 'shared' else s_name end as name, s_suppkey % 11 = 0 as failed from supplier)"


def _specs(x: Lens) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lit(None)).when(F.col("s_suppkey") % 7 == 0, "shared").otherwise(F.col("s_name"))
    return x.table("supplier").select(name.alias("name"), (F.col("s_suppkey") % 11 == 0).alias("failed"))


@query(f"select distinct name from (select name from {_SPECS} union all select s_name from supplier where s_suppkey % 5 = 0) where name is not null", lens=False)
def k9_fleet_keep(x: Lens) -> DataFrame:
    named = x.table("supplier").filter("s_suppkey % 5 = 0").select(F.col("s_name").alias("name"))
    return crawl.fleet_keep(_specs(x), named, _specs(x).filter("failed"))[0]


@query(f"select name, count(*) as n from {_SPECS} where name is not null group by 1 having count(*) > 1", lens=False)
def k10_duplicate_overrides(x: Lens) -> DataFrame:
    return crawl.duplicate_names(_specs(x))


@query(f"select name, count(*) as n from (select s_name as name from supplier union all select name from {_SPECS} where failed) where name is not null group by 1 having count(*) > 1", lens=False)
def k11_duplicate_identities(x: Lens) -> DataFrame:
    return crawl.duplicate_names(x.table("supplier").select(F.col("s_name").alias("name")), _specs(x).filter("failed"))


@query(
    """, keep as (select s_name as server from supplier where s_suppkey % 3 <> 0), kept_tools as (select tool_key, server in (select server from keep) as stays from tools where server in (select server from keep) or tool_key in (select tool_key from authored_keys)),
  kept_uris as (select uri from resources where uri not in (select uri from provides where server not in (select server from keep)) or uri in (select uri from provides where server in (select server from keep)) or uri in (select uri from data_access) or uri in (select uri from governed_resource))
  select 'server' as kind, server as key from (select distinct server from tools) where server in (select server from keep) union all select 'tool', tool_key from kept_tools union all select 'resource', uri from kept_uris"""
)
def k12_retire_servers(x: Lens) -> DataFrame:
    keep = x.table("supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"))
    g = crawl.retire_servers(x.graph, keep)
    parts = [g.servers.select(F.lit("server").alias("kind"), F.col("name").alias("key")), g.tools.select(F.lit("tool"), "key"), g.resources.select(F.lit("resource"), "uri")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""select server, count(*) as records, sum(octet_length(encode('{"tool":"' || tool || '","tool_key":"' || tool_key || '"}')))::bigint as bytes, count(*) > 100 as refused from tools group by 1""")
def k13_catalog_budget(x: Lens) -> DataFrame:
    rows = x.graph.tools.select("server", F.col("name").alias("tool"), F.col("key").alias("tool_key"))
    return crawl.catalog_budget(rows, ["tool", "tool_key"], most_records=100)


_PARTS = "(select s_name as server, case when p_partkey % 10 = 0 then 'a::' || p_partkey else 'part-' || p_partkey end as tool from part join supplier on s_suppkey = p_partkey % 10 + 1)"


@query(f"select server, tool, case when not contains(tool, '::') then server || '::' || tool end as tool_key from {_PARTS}", lens=False)
def k14_tool_key(x: Lens) -> DataFrame:
    p, s = x.table("part"), x.table("supplier")
    rows = p.join(s, F.col("s_suppkey") == F.col("p_partkey") % 10 + 1)
    tool = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("a::"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    fine, refused = crawl.composed_keys(rows.select(F.col("s_name").alias("server"), tool.alias("tool")))
    return fine.unionByName(refused.withColumn("tool_key", F.lit(None).cast("string")))


@query(
    r"""select 'page' as what, page_id as id, lower(regexp_extract(url, '^([A-Za-z]+://)[^/?#]*', 1)) || lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#@]+)', 1)) as label from pages
  union all select 'part', p_partkey, case p_partkey % 4 when 0 then 'run-' || p_partkey when 1 then 'my tool ' || p_partkey when 2 then 'x' || p_partkey || '.exe' end from part""",
    lens=False,
)
def k15_endpoint_label(x: Lens) -> DataFrame:
    """Of web endpoints scheme, host and port; of commands (bare, quoted with spaces, of another system, blank) the executable's base name."""
    k = F.col("p_partkey").cast("string")
    command = F.concat(F.lit("/usr/bin/run-"), k, F.lit(" --token abc /etc/x"))
    command = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('  "/opt/a b/my tool '), k, F.lit('" -v'))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("'C:\\dir one\\x"), k, F.lit(".exe' serve"))).when(F.col("p_partkey") % 4 == 3, "  ").otherwise(command)
    pages = x.table("pages").select(F.lit("page").alias("what"), F.col("page_id").alias("id"), crawl.endpoint_label(F.lit("http"), F.col("url")).alias("label"))
    return pages.unionByName(x.table("part").select(F.lit("part").alias("what"), F.col("p_partkey").alias("id"), crawl.endpoint_label(F.lit("stdio"), command).alias("label")))


# ---- Manifest checks and application --------------------------------------------------


def _broken(x: Lens):
    """The proposed manifest with faults of every kind."""
    m, one = x.proposed, F.lit(9).cast("long").alias("seq")
    some = m.policies.filter("length(id) % 5 = 1")
    thrice = some.filter("scope in ('ASIA', 'EUROPE')")
    grants = m.grants.limit(0).unionByName(x.candidates.select(one, "agent", "ref", F.lit(None).cast("string").alias("granted_by"), F.lit(None).cast(m.grants.schema["prov"].dataType).alias("prov")))
    undefined = m.bindings.filter("field = 'governed_resources'").withColumn("policy", F.concat(F.col("policy"), F.lit("-x")))
    twice = m.bindings.filter("field = 'governed_resources'").withColumn("field", F.lit("governed_by"))
    return m.with_tables(policies=m.policies.unionByName(some).unionByName(thrice), grants=m.grants.unionByName(grants), bindings=m.bindings.unionByName(undefined).unionByName(twice))


_BAD_REFS = "(select distinct agent, ref, case when keys is null then 'not found' when len(keys) > 1 then 'ambiguous' end as problem from candidates left join resolved using (ref))"


def _warnings(x: Lens) -> DataFrame:
    return manifest.check_manifest(_broken(x), x.graph)[0]


@query("select id, case when scope in ('ASIA', 'EUROPE') then 3 else 2 end::bigint as n from policies where length(id) % 5 = 1")
def v1_duplicate_policy(x: Lens) -> DataFrame:
    told = _warnings(x).filter("code = 'DUPLICATE_POLICY'").select(F.col("subject").alias("id"))
    return manifest.duplicate_policies(_broken(x)).join(told, "id")


@query(REORGANISED_SQL + "select id as agent from agents4")
def v2_known_agents(x: Lens) -> DataFrame:
    return manifest.known_agents(x.reorganised)


@query("select ref as subject, 'grant of ''' || ref || ''': ' || case when keys is null then 'not found' else 'ambiguous' end as message from candidates left join resolved using (ref) where keys is null or len(keys) > 1")
def v3_grant_tool(x: Lens) -> DataFrame:
    return _warnings(x).filter("code = 'GRANT_TOOL'").select("subject", "message")


@query("select distinct 'part-' || p_partkey as subject from part where 'part-' || p_partkey not in (select tool from tools) or 'part-' || p_partkey in (select tool from tools group by 1 having count(*) > 1)")
def v4_access_tool(x: Lens) -> DataFrame:
    m = x.proposed
    parts = x.table("part").select(F.lit(0).cast("long").alias("seq"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("ref"), F.lit("READS").alias("mode"), F.lit("store:x").alias("resource"), F.lit(None).cast(m.data_access.schema["prov"].dataType).alias("prov"))
    return manifest.check_manifest(m.with_tables(data_access=parts), x.graph)[0].filter("code = 'ACCESS_TOOL'").select("subject").distinct()


_BOUND = "(select uri as node, policy, 'resource' as kind from governed_resource2 union all select tool_key, policy, 'tool' from governed_tool2)"


@query(AFTER_SQL + f"select node, policy, kind from {_BOUND}")
def v5_binding_kind(x: Lens) -> DataFrame:
    m = x.proposed
    free = m.bindings.withColumn("field", F.lit("governed_by"))
    return manifest.resolve_manifest(m.with_tables(bindings=free), x.graph.tools).bindings.select("node", "policy", "kind")


@query(AFTER_SQL + "select policy || '-x' as subject, count(*) as n from governed_resource2 group by 1")
def v8_undefined_policy(x: Lens) -> DataFrame:
    return _warnings(x).filter("code = 'UNDEFINED_POLICY'").groupBy("subject").agg(F.count("*").alias("n"))


@query(AFTER_SQL + "select uri as subject, count(*) as n from governed_resource2 group by 1")
def v10_bound_twice(x: Lens) -> DataFrame:
    return _warnings(x).filter("code = 'BOUND_TWICE'").groupBy("subject").agg(F.count("*").alias("n"))




@query("select tool_key as subject from tools where contains(tool, '9')")
def v6_resource_is_tool(x: Lens) -> DataFrame:
    m = x.proposed
    tools = x.graph.tools.withColumn("key", F.concat(F.lit("mem:"), F.col("key"))).withColumn("name", F.concat(F.lit("mem:"), F.col("key")))
    some = tools.filter("split_part(key, '::', 2) like '%9%'")
    rows = some.select(F.lit(0).cast("long").alias("seq"), F.lit("governed_by").alias("field"), F.col("key").alias("node"), F.lit("p").alias("policy"), F.lit(None).cast(m.bindings.schema["prov"].dataType).alias("prov"))
    got = manifest.binding_checks(m.with_tables(bindings=rows), manifest.resolve_manifest(m.with_tables(bindings=rows), tools))
    return got.filter("code = 'RESOURCE_IS_TOOL'").select(F.expr("substr(subject, 5)").alias("subject"))


@query(AFTER_SQL + "select distinct 'x' || uri as subject from data_access2 where uri like '%/P%'")
def v7_tool_is_resource(x: Lens) -> DataFrame:
    m = x.proposed
    bare = m.data_access.withColumn("resource", F.concat(F.lit("x"), F.regexp_replace("resource", "^store:", "")))
    rows = bare.filter("resource like '%/P%'").select("seq", F.lit("governed_by").alias("field"), F.col("resource").alias("node"), F.lit("p").alias("policy"), "prov").dropDuplicates(["node"])
    m = m.with_tables(data_access=bare, bindings=rows)
    got = manifest.binding_checks(m, manifest.resolve_manifest(m, x.graph.tools)).filter("code = 'TOOL_IS_RESOURCE'")
    return got.select(F.concat(F.lit("xstore:"), F.expr("substr(subject, 2)")).alias("subject"))


@query(AFTER_SQL + "select tool_key || '-gone' as subject, 'governed tool ''' || tool_key || '-gone'': not found' as message from governed_tool2")
def v9_governed_tool(x: Lens) -> DataFrame:
    m = x.proposed
    m = m.with_tables(bindings=m.bindings.withColumn("node", F.when(F.col("field") == "governed_tools", F.concat("node", F.lit("-gone"))).otherwise(F.col("node"))))
    return manifest.check_manifest(m, x.graph)[0].filter("code = 'GOVERNED_TOOL'").select("subject", "message")


_EXCEPTION_CODES = """, e as (select e.*, e.agent in (select agent from can_call2 union select id from agents where id not like '%7') as has_agent, p.id is not null as has_policy, p.effect, c.agent is not null as has_grant,
    exists (select 1 from data_access2 a where a.tool_key = e.tool_key and a.uri = e.resource) as has_access, exists (select 1 from governed_resource2 g where g.uri = e.resource and g.policy = e.policy) as has_bound,
    exists (select 1 from data_access2 a join governed_resource2 g using (uri) where a.tool_key = e.tool_key and g.policy = e.policy) or exists (select 1 from governed_tool2 g where g.tool_key = e.tool_key and g.policy = e.policy) as has_path,
    a.id is not null as declared
  from exceptions e left join policies2 p on p.id = e.policy left join can_call2 c on c.agent = e.agent and c.tool_key = e.tool_key left join (select id from agents where id not like '%7') a on a.id = e.agent)
  select agent, tool_key || case when agent like '%5' then '-gone' else '' end as tool_key, resource, policy, case when not declared then 'EXCEPTION_AGENT' when not has_policy then 'EXCEPTION_POLICY' when effect = 'ALLOW' then 'EXCEPTION_ALLOW' when agent like '%5' then 'EXCEPTION_TOOL' when not has_grant then 'EXCEPTION_GRANT'
    when resource is not null and not has_access then 'EXCEPTION_ACCESS' when resource is not null and not has_bound then 'EXCEPTION_BINDING' when resource is null and not has_path then 'EXCEPTION_PATH' end as code from e"""


def _flags(x: Lens) -> DataFrame:
    m = x.proposed
    lost = F.when(F.col("agent").like("%5"), F.concat("ref", F.lit("-gone"))).otherwise(F.col("ref"))
    m = m.with_tables(exceptions=x.manifest.exceptions.withColumn("ref", lost), agents=m.agents.filter("id not like '%7'"))
    return manifest.exception_flags(m, manifest.resolve_manifest(m, x.graph.tools)).select("agent", F.col("ref").alias("tool_key"), "resource", "policy", "code")


@query(AFTER_SQL + _EXCEPTION_CODES)
def v11_to_v18_exception_checks(x: Lens) -> DataFrame:
    return _flags(x)


@query(AFTER_SQL + ", k as (select tool_key from can_call2 union select tool_key from data_access2 union select tool_key from governed_tool2 union select tool_key from exceptions2) select tool_key as subject from k anti join exposes using (tool_key)")
def v19_drift(x: Lens) -> DataFrame:
    return manifest.drift_notices(manifest.resolve_manifest(x.proposed, x.graph.tools), x.graph.exposes).select("subject")


@query("select agent, tool_key, granted_by from (select c_name as agent, tool_key, o_orderpriority as granted_by, row_number() over (partition by c_name, tool_key order by l_orderkey * 10 + l_linenumber desc) as n from li join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) where n = 1")
def v20_last_entry_wins(x: Lens) -> DataFrame:
    o, c = x.table("orders"), x.table("customer")
    rows = x.lines.join(o, x.lines.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return crawl.last_of(rows.select(F.col("c_name").alias("agent"), "tool_key", F.col("o_orderpriority").alias("granted_by"), "seq"), ["agent", "tool_key"]).drop("seq")


@query(
    """select code, count(*) as n from (select case right(id, 1) when '1' then 'MISSING' when '2' then 'SEPARATOR' else 'CREDENTIAL' end as code from agents where right(id, 1) in ('1', '2', '3') union all select 'MISSING' from can_call where granted_by = '1-URGENT'
  union all select 'EFFECT' from policies where length(id) % 2 = 0 union all select 'MODE' from data_access where mode = 'READS' union all select 'PROVENANCE' from governed_tool) group by 1"""
)
def v21_field_checks(x: Lens) -> DataFrame:
    m, end = x.manifest, F.right("id", F.lit(1))
    name = F.when(end == "1", "").when(end == "2", F.concat("id", F.lit("::x"))).when(end == "3", F.concat(F.lit("https://u:p@"), "id")).otherwise(F.col("id"))
    m = m.with_tables(
        agents=m.agents.withColumn("id", name),
        policies=m.policies.withColumn("effect", F.when(F.length("id") % 2 == 0, "MAYBE").otherwise(F.col("effect"))),
        grants=m.grants.withColumn("ref", F.when(F.col("granted_by") == "1-URGENT", " ").otherwise(F.col("ref"))),
        data_access=m.data_access.withColumn("mode", F.when(F.col("mode") == "READS", "LOOKS").otherwise(F.col("mode"))),
        bindings=m.bindings.withColumn("prov", F.when(F.col("field") == "governed_tools", F.col("prov").withField("source", F.lit("guess"))).otherwise(F.col("prov"))),
    )
    return manifest.field_checks(m).groupBy("code").agg(F.count("*").alias("n"))


def after(x: Lens) -> Graph:
    return manifest.apply_manifest(x.proposed, x.graph)


@query(AFTER_SQL + f"select 'proposed' as manifest, true as applied, 0::bigint as warnings union all select 'broken', false, (select count(*) from {_BAD_REFS} where problem is not null)")
def m1_atomic_gate(x: Lens) -> DataFrame:
    m = x.proposed
    clean = m.with_tables(exceptions=m.exceptions.limit(0))
    refs = x.candidates.select(F.lit(9).cast("long").alias("seq"), "agent", "ref", F.lit(None).cast("string").alias("granted_by"), F.lit(None).cast(m.grants.schema["prov"].dataType).alias("prov")).dropDuplicates(["agent", "ref"])
    rows = []
    for name, it in (("proposed", clean), ("broken", clean.with_tables(grants=refs))):
        _, warnings, _, applied = manifest.ingest(it, x.graph)
        rows.append(warnings.agg(F.count("*").alias("warnings")).select(F.lit(name).alias("manifest"), F.lit(applied).alias("applied"), "warnings"))
    return rows[0].unionByName(rows[1])


@query(AFTER_SQL + "select agent, tool_key, granted_by, evidence from can_call2")
def m2_replace_grants(x: Lens) -> DataFrame:
    return after(x).can_call.select("agent", "tool_key", "granted_by", "prov.evidence")


@query(AFTER_SQL + "select tool_key, mode, uri, evidence from data_access2")
def m3_replace_access(x: Lens) -> DataFrame:
    return after(x).data_access.select("tool_key", "mode", "uri", "prov.evidence")


@query(AFTER_SQL + """select agent, tool_key, resource, policy, reason, sha256('["' || agent || '","' || tool_key || '","' || resource || '","' || policy || '"]') as key from exceptions2""")
def m4_replace_exceptions(x: Lens) -> DataFrame:
    e = after(x).exceptions
    return e.withColumn("key", manifest.exception_key(*[F.col(c) for c in ("agent", "tool_key", "resource", "policy")])).select("agent", "tool_key", "resource", "policy", "reason", "key")


@query(AFTER_SQL + "select 'resource' as target_kind, uri as target, policy, evidence from governed_resource2 union all select 'tool', tool_key, policy, evidence from governed_tool2")
def m5_replace_bindings(x: Lens) -> DataFrame:
    return diff.bindings(after(x)).select("target_kind", "target", "policy", "prov.evidence")


@query(AFTER_SQL + "select 'agent' as kind, id, null as effect from agents union all select 'policy', id, effect from policies2")
def m6_sync_agents_policies(x: Lens) -> DataFrame:
    g = after(x)
    return g.agents.select(F.lit("agent").alias("kind"), "id", F.lit(None).cast("string").alias("effect")).unionByName(g.policies.select(F.lit("policy").alias("kind"), "id", "effect"))


@query(AFTER_SQL + "select uri from resources2")
def m7_prune_resources(x: Lens) -> DataFrame:
    return after(x).resources.select("uri")


@query(AFTER_SQL + "select tool_key as key from tools2")
def m8_prune_tools(x: Lens) -> DataFrame:
    return after(x).tools.select("key")


#: Rows of the manifest as canonical JSON; `sorted_digest` of h(h) as SQL.
_PROV_JSON = """'{"source":"operator_asserted","confidence":"high","evidence":' || coalesce('"' || evidence || '"', 'null') || '}'"""
_MANIFEST_ROWS = f""", texts as (select 'agents:{{"id":"' || id || '","seq":0}}' as t from agents union all select 'policies:{{"description":null,"effect":"' || effect || '","id":"' || id || '","scope":"' || scope || '","seq":0}}' from policies
  union all select 'grants:{{"agent":"' || agent || '","granted_by":"' || granted_by || '","prov":' || {_PROV_JSON} || ',"ref":"' || tool_key || '","seq":0}}' from can_call
  union all select 'data_access:{{"mode":"' || mode || '","prov":' || {_PROV_JSON} || ',"ref":"' || tool_key || '","resource":"' || uri || '","seq":0}}' from data_access
  union all select 'bindings:{{"field":"governed_resources","node":"' || uri || '","policy":"' || policy || '","prov":' || {_PROV_JSON} || ',"seq":0}}' from governed_resource
  union all select 'bindings:{{"field":"governed_tools","node":"' || tool_key || '","policy":"' || policy || '","prov":' || {_PROV_JSON} || ',"seq":0}}' from governed_tool
  union all select 'exceptions:{{"agent":"' || agent || '","policy":"' || policy || '","reason":"' || reason || '","ref":"' || tool_key || '","resource":' || coalesce('"' || resource || '"', 'null') || ',"seq":0}}' from exceptions),
  hashed as (select sha256(t) as h from texts)"""
SORTED_DIGEST = """, fine as (select left(h, 6) as p, sha256(string_agg(h, '' order by h)) as d, count(*) as n from hashed group by 1), coarse as (select left(p, 3) as q, sha256(string_agg(d, '' order by p)) as d, sum(n) as n from fine group by 1)
  select sha256(string_agg(d, '' order by q)) as digest, sum(n)::bigint as {rows} from coarse"""


@query(_MANIFEST_ROWS + SORTED_DIGEST.format(rows="rows"))
def m9_governance_digest(x: Lens) -> DataFrame:
    return manifest.governance_digest(x.manifest)


# ---- Manifest diff ------------------------------------------------------------------------

_KEY = "select op, key from"


def _ops(df: DataFrame) -> DataFrame:
    return df.select("op", "key")


def reorganised(x: Lens) -> Graph:
    return manifest.apply_manifest(x.reorganised, x.graph)


@query(REORGANISED_SQL + "select 'deleted' as op, id as key from agents where id not in (select id from agents4) union all select 'created', id from agents4 where id not in (select id from agents)")
def d1_agents(x: Lens) -> DataFrame:
    return _ops(diff.agents(x.graph, reorganised(x)))


@query(AFTER_SQL + "select 'modified' as op, id as key from policies join policies2 q using (id) where policies.effect <> q.effect")
def d2_policies(x: Lens) -> DataFrame:
    return _ops(diff.policies(x.graph, after(x)))


@query(AFTER_SQL + "select 'revoked' as op, agent || ' | ' || tool_key as key from can_call anti join can_call2 using (agent, tool_key) union all select 'added', agent || ' | ' || tool_key from can_call2 anti join can_call using (agent, tool_key)")
def d3_grants(x: Lens) -> DataFrame:
    return _ops(diff.grants(x.graph, after(x)))


@query(AFTER_SQL + "select 'modified' as op, agent || ' | ' || tool_key as key from can_call c join can_call2 d using (agent, tool_key) where c.granted_by is distinct from d.granted_by")
def d4_granted_by(x: Lens) -> DataFrame:
    return _ops(diff.granted_by(x.graph, after(x)))


@query(AFTER_SQL + "select 'data_access_provenance' as kind, tool_key || ' | ' || mode || ' | ' || uri as key from data_access c join data_access2 d using (tool_key, mode, uri) where c.evidence is distinct from d.evidence")
def d5_provenance(x: Lens) -> DataFrame:
    return diff.provenance(x.graph, after(x)).select("kind", "key")


@query(AFTER_SQL + "select 'removed' as op, tool_key || ' | ' || mode || ' | ' || uri as key from data_access anti join data_access2 using (tool_key, mode, uri)")
def d6_data_access(x: Lens) -> DataFrame:
    return _ops(diff.data_access(x.graph, after(x)))


@query(
    REORGANISED_SQL + "select 'removed' as op, target_kind || ' | ' || target || ' | ' || policy as key from (select * from bound except select * from bound4) union all select 'added', target_kind || ' | ' || target || ' | ' || policy from (select * from bound4 except select * from bound)"
)
def d7_bindings(x: Lens) -> DataFrame:
    return _ops(diff.binding_changes(x.graph, reorganised(x)))


@query("select case when reason = 'wildcard' then 'removed' else 'reason_updated' end as op, agent || ' | ' || tool_key || ' | ' || coalesce(resource, '*') || ' | ' || policy as key from exceptions where reason = 'wildcard' or resource like 'store:2%'")
def d8_exceptions(x: Lens) -> DataFrame:
    return _ops(diff.exceptions(x.graph, after(x)))


@query(
    REORGANISED_SQL
    + """, b as (select uri from data_access union select uri from governed_resource) select 'pruned' as op, uri as key from resources anti join resources4 using (uri) union all select 'created', uri from resources4 anti join resources using (uri)
  union all select 'retained_crawled', uri from b anti join named4 using (uri) semi join provides using (uri)"""
)
def d9_resources(x: Lens) -> DataFrame:
    return _ops(diff.resources(x.graph, reorganised(x)))


@query(AFTER_SQL + """, a as (select tool_key from can_call2 union select tool_key from data_access2 union select tool_key from governed_tool2)
  select 'pruned' as op, tool_key as key from tools anti join tools2 using (tool_key) union all select 'retained_crawled', tool_key from authored_keys anti join a using (tool_key) semi join exposes using (tool_key)""")
def d10_tools(x: Lens) -> DataFrame:
    # Exceptions are no edges, so no tool goes or stays by them, and they are not derived.
    g = x.graph.with_tables(exceptions=x.spark.createDataFrame([], SCHEMAS["exceptions"]))
    return _ops(diff.tools(g, manifest.apply_manifest(x._proposed(x._manifest(g), g), g)))


@query(
    AFTER_SQL
    + """, gone_ as (select tool_key, mode, uri from data_access anti join data_access2 using (tool_key, mode, uri)), held as (select uri from data_access2 union select uri from governed_resource2), kept as (select tool_key from can_call2 union select tool_key from data_access2 union select tool_key from governed_tool2),
  rows_ as (select 'grant' as kind, 'revoked' as op from can_call anti join can_call2 using (agent, tool_key) union all select 'grant', 'added' from can_call2 anti join can_call using (agent, tool_key) union all select 'policy', 'modified' from policies join policies2 q using (id) where policies.effect <> q.effect
  union all select 'granted_by', 'modified' from can_call c join can_call2 d using (agent, tool_key) where c.granted_by is distinct from d.granted_by union all select 'data_access_provenance', 'modified' from data_access c join data_access2 d using (tool_key, mode, uri) where c.evidence is distinct from d.evidence
  union all select 'data_access', 'removed' from gone_ union all select 'binding', 'removed' from (select uri from governed_resource where length(policy) % 7 = 0 union all select tool_key from governed_tool where length(policy) % 7 = 0)
  union all select 'exception', case when reason = 'wildcard' then 'removed' else 'reason_updated' end from exceptions where reason = 'wildcard' or resource like 'store:2%'
  union all select 'resource', 'pruned' from resources anti join resources2 using (uri) union all select 'resource', 'retained_crawled' from (select uri from data_access union select uri from governed_resource) anti join held using (uri) semi join provides using (uri)
  union all select 'tool', 'pruned' from tools anti join tools2 using (tool_key) union all select 'tool', 'retained_crawled' from authored_keys anti join kept using (tool_key) semi join exposes using (tool_key))
  select kind, op, count(*) as n from rows_ group by 1, 2"""
)
def d11_summary(x: Lens) -> DataFrame:
    return diff.summary(x.graph, after(x))
