"""Registered queries of decisions, proposals, control plans, reviews, snapshots and text scrubbing."""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.more_queries import SORTED_DIGEST
from palisade.operators import decisions, manifest, propose, review, scrub
from palisade.plans import control
from palisade.queries import query
from palisade.sources import artifacts, snapshots
from palisade.sources.lens import AFTER_SQL, AskedLens, Lens, StoredLens
from palisade.sources.schema import spread
from palisade.sources.snapshots import stored


def _re2(pattern: str) -> str:
    """An expression as a string of DuckDB's SQL, whose expressions know no look-ahead; a test holds either way."""
    return "'" + pattern.replace("(?=", "(?:").replace("'", "''") + "'"


_SHAPED = " or ".join(f"regexp_matches(text, {_re2(p)})" for p in scrub.REFUSED)

def _cycled(values: list, k):
    """The value of a list that a number picks, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _damaged(value, ways: list, k):
    """A text with what a way finds replaced; ways: (found, put in place, problem told or None)."""
    return F.regexp_replace(value, _cycled([w[0] for w in ways], k), _cycled([w[1] for w in ways], k))


def _told(ways: list, k: str) -> str:
    """The problem told of a way, in SQL."""
    return "[" + ", ".join("null" if w[2] is None else "'" + w[2].replace("'", "''") + "'" for w in ways) + f"][{k} % {len(ways)} + 1]"


# ---- Decision tables ---------------------------------------------------------------

_STRICT = "list_filter(reasons, lambda x: list_contains(['TOOL_NOT_FOUND', 'AMBIGUOUS_TOOL', 'NOT_GRANTED', 'DENY_VIOLATION', 'DENY_GOVERNED', 'DRIFTED', 'UNMAPPED'], x))[1]"


@query("""select tool_key as key, sha256('{"description":null,"destructive_hint":' || coalesce(destructive_hint::varchar, 'null') || ',"idempotent_hint":null,"input_schema":null,"key":"' || tool_key || '","name":"' || tool || '","open_world_hint":null,"read_only_hint":' || coalesce(read_only_hint::varchar, 'null') || ',"server":"' || server || '"}') as digest from tools where exposed""")
def b1_contract_digest(x: Lens) -> DataFrame:
    return decisions.exposed_catalog(x.graph).select("key", decisions.contract_digest().alias("digest"))


_CONTRACTS = """, contracts as (select tool_key as key, sha256('{"description":null,"destructive_hint":' || coalesce(destructive_hint::varchar, 'null') || ',"idempotent_hint":null,"input_schema":null,"key":"' || tool_key || '","name":"' || tool || '","open_world_hint":null,"read_only_hint":' || coalesce(read_only_hint::varchar, 'null') || ',"server":"' || server || '"}') as digest, exposed from tools)"""


@query(_CONTRACTS + """, hashed as (select sha256('{"key":"' || key || '","contract":"' || digest || '"}') as h from contracts where exposed)""" + SORTED_DIGEST.format(rows="n"))
def b2_catalog_digest(x: Lens) -> DataFrame:
    return decisions.catalog_digest(x.graph)


_BUNDLE = """, pairs as (select agent, tool_key from can_call semi join exposes using (tool_key)),
  bundle as (select p.agent, p.tool_key, case when w.violation then 'DENY_VIOLATION' when w.n_paths > 0 then 'DENY_GOVERNED' when f.is_unmapped then 'UNMAPPED' end as reason,
    case when w.violation then 1.0 when f.is_unmapped then 0.6 when f.has_unbacked_edges then 0.4 when w.n_paths > 0 then 0.2 else 0.0 end::double as risk_score from pairs p join facts f using (tool_key) left join worst w on w.agent = p.agent and w.tool_key = p.tool_key)"""


def _bundle(x: Lens) -> DataFrame:
    return decisions.policy_bundle(x.graph, x.graph.agents.select(F.col("id").alias("agent")))


@query(_BUNDLE + " select agent, tool_key, case when reason is null then 'eligible' else 'rejected' end as decision, reason, risk_score from bundle")
def b3_policy_bundle(x: Lens) -> DataFrame:
    return _bundle(x).select("agent", "tool_key", "decision", "reason", "risk_score")


@query("select tool_key, 'rejected' as decision, 'NOT_GRANTED' as reason, case when tool_key in (select tool_key from tool_deny) then 1.0 when is_unmapped then 0.6 when has_unbacked_edges then 0.4 else 0.0 end::double as risk_score from facts where not is_drifted")
def b3_ungranted_rule(x: Lens) -> DataFrame:
    return decisions.ungranted_rule(x.graph)


@query(_BUNDLE + " select 'missing' as problem, count(*) as n from bundle where agent like '%3' and tool_key like '%5' having count(*) > 0")
def b4_bundle_checks(x: Lens) -> DataFrame:
    damaged = _bundle(x).filter("not (agent like '%3' and tool_key like '%5')")
    return decisions.bundle_problems(damaged, x.graph).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"""select agent || '-run' as run_id, agent, case when count(*) filter (where {_STRICT} is not null) > 0 then 'advisory_warn' else 'advisory_allow' end as decision, count(distinct tool_key) filter (where {_STRICT} is null) as eligible, count(*) filter (where {_STRICT} is not null) as rejected from scored group by agent
  union all select 'ghost-run', 'ghost', 'unresolved_identity', 0, 0""", of=AskedLens)
def b5_preflight(x: AskedLens) -> DataFrame:
    runs = x.candidates.select(F.concat("agent", F.lit("-run")).alias("run_id"), "agent", "pos", "ref")
    ghost = x.spark.range(1).select(F.lit("ghost-run").alias("run_id"), F.lit("ghost").alias("agent"), F.lit(1).alias("pos"), F.lit("a::b").alias("ref"))
    return decisions.preflight(x.asked_graph, runs.unionByName(ghost))


@query(_CONTRACTS + """, hashed as (select sha256('{"ref":"' || ref || '","key":"' || key || '","exposed":' || exposed || ',"contract":"' || digest || '"}') as h from (select ref, unnest(keys) as key from resolved) join contracts using (key))""" + SORTED_DIGEST.format(rows="n"), of=AskedLens)
def b7_scoped_catalog_digest(x: AskedLens) -> DataFrame:
    return decisions.scoped_catalog_digest(x.asked_graph, x.candidates)


#: Decisions before and after the proposed manifest for the candidates.
_TWO = AFTER_SQL + f""",
tool_deny2 as (select a.tool_key, a.uri as resource, g.policy from data_access2 a join governed_resource2 g using (uri) join policies2 p on p.id = g.policy and p.effect = 'DENY' union all select g.tool_key, null, g.policy from governed_tool2 g join policies2 p on p.id = g.policy and p.effect = 'DENY'),
resolved2 as (select ref, list_sort(list(distinct tool_key)) as keys from (select distinct ref from candidates) r join (select tool_key, tool from tools semi join tools2 using (tool_key)) t on case when contains(r.ref, '::') then t.tool_key = r.ref else t.tool = r.ref end group by ref),
asked2 as materialized (select c.agent, c.pos, c.ref, r.keys, case when len(r.keys) = 1 then r.keys[1] end as tool_key from candidates c left join resolved2 r using (ref)),
worst2 as (select d.agent, d.tool_key, bool_or(not exists (select 1 from exceptions2 e where e.agent = d.agent and e.tool_key = d.tool_key and e.policy = d.policy and (e.resource is null or e.resource = d.resource))) as violation from (select distinct q.agent, t.* from asked2 q join tool_deny2 t using (tool_key)) d group by 1, 2),
facts2 as (select t.tool_key, not t.exposed as is_drifted, a.tool_key is null as is_unmapped, coalesce(a.no_evidence, false) or coalesce(g.no_evidence, false) or coalesce(r.no_evidence, false) as unbacked from tools t semi join tools2 using (tool_key)
  left join (select tool_key, bool_or(evidence is null) as no_evidence from data_access2 group by 1) a using (tool_key) left join (select tool_key, bool_or(evidence is null) as no_evidence from governed_tool2 group by 1) g using (tool_key)
  left join (select a.tool_key, bool_or(g.evidence is null) as no_evidence from data_access2 a join governed_resource2 g using (uri) group by 1) r using (tool_key)),
new_ as materialized (select q.agent, q.pos, q.ref, q.tool_key, case when q.tool_key is null then 'unresolved' when k.tool_key is null or w.violation is not null or f.is_drifted or f.is_unmapped then 'rejected' else 'eligible' end as decision,
  case when q.keys is null then 'TOOL_NOT_FOUND' when len(q.keys) > 1 then 'AMBIGUOUS_TOOL' when k.tool_key is null then 'NOT_GRANTED' when w.violation then 'DENY_VIOLATION' when w.violation is not null then 'DENY_GOVERNED' when f.is_drifted then 'DRIFTED' when f.is_unmapped then 'UNMAPPED' end as reason,
  case when q.tool_key is null then null when w.violation then 1.0 when f.is_drifted then 0.8 when f.is_unmapped then 0.6 when f.unbacked then 0.4 when w.violation is not null then 0.2 else 0.0 end::double as risk_score
  from asked2 q left join facts2 f using (tool_key) left join can_call2 k on k.agent = q.agent and k.tool_key = q.tool_key left join worst2 w on w.agent = q.agent and w.tool_key = q.tool_key),
old_ as materialized (select agent, pos, candidate as ref, tool_key, case when not found or ambiguous then 'unresolved' when {_STRICT} is null then 'eligible' else 'rejected' end as decision, {_STRICT} as reason, risk_score from scored),
impact_ as materialized (select agent, pos, ref, o.decision as before, n.decision as after, case when o.decision = 'unresolved' or n.decision = 'unresolved' then 'unresolved' when o.decision <> 'eligible' and n.decision = 'eligible' then 'newly_eligible' when o.decision = 'eligible' and n.decision <> 'eligible' then 'newly_rejected' else 'unchanged' end as change,
  (o.decision, o.reason, o.tool_key, o.risk_score) is distinct from (n.decision, n.reason, n.tool_key, n.risk_score) as details_changed from old_ o join new_ n using (agent, pos, ref))"""


def _both(x: AskedLens) -> tuple[DataFrame, DataFrame]:
    """The candidates decided before and after the proposed manifest."""
    return decisions.decided(x.changing_graph, x.candidates), decisions.hypothetical(x.proposed, x.changing_graph, x.candidates)


def _impact(x: AskedLens) -> DataFrame:
    return decisions.impact(*_both(x))


@query(_TWO + " select agent, pos, ref, decision, reason, tool_key, risk_score from new_", of=AskedLens)
def b8_hypothetical_decisions(x: AskedLens) -> DataFrame:
    return decisions.hypothetical(x.proposed, x.changing_graph, x.candidates)


@query(_TWO + " select agent, pos, ref, decision, reason, tool_key, risk_score from old_", of=AskedLens)
def b9_impact_decision(x: AskedLens) -> DataFrame:
    return decisions.decided(x.asked_graph, x.candidates)


@query(_TWO + " select agent, pos, ref, before, after, change, details_changed from impact_", of=AskedLens)
def b10_impact_rows(x: AskedLens) -> DataFrame:
    return _impact(x).select("agent", "pos", "ref", "before", "after", "change", "details_changed")


@query(_TWO + " select bool_and(change <> 'unresolved') as ready from impact_", of=AskedLens)
def b11_regression_ready(x: AskedLens) -> DataFrame:
    return decisions.regression_ready(_impact(x))


@query(_TWO + " select agent, ref, (o.decision, o.reason, o.tool_key) is not distinct from (n.decision, n.reason, n.tool_key) as matches from (select distinct agent, ref, decision, reason, tool_key from old_) o join (select distinct agent, ref, decision, reason, tool_key from new_) n using (agent, ref)", of=AskedLens)
def b12_impact_check(x: AskedLens) -> DataFrame:
    old, new = (df.select("agent", "ref", "decision", "reason", "tool_key").distinct() for df in _both(x))
    return decisions.impact_check(old, new)


@query("select o_orderkey::varchar as state, case when o_orderkey % 3 = 0 then 'no digest' else 'no generation' end as problem from orders where o_orderkey % 3 < 2", lens=False)
def b13_state_checks(x: Lens) -> DataFrame:
    k, name = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    rows = x.table("orders").select(name.alias("state"), name.alias("instance_id"), F.when(k % 3 == 0, "zz").otherwise(F.sha2(name, 256)).alias("governance_digest"), F.when(k % 3 == 1, -1).otherwise(k).alias("generation"))
    return rows.select("state", F.explode(decisions.state_checks()).alias("problem"))


#: Ways to damage a reviewed comparison.
_IMPACTS = [
    ("$", "", None),
    ('"schema_version":1', '"schema_version":true', "schema_version: must be an integer"),
    ('"mode":"advisory"', '"mode":"binding"', "mode: must be one of the known values"),
    ('"mode":"advisory"', '"mode":"advisory","mode":"advisory"', "not JSON"),
    ('"generation":7', '"generation":NaN', "not JSON"),
    ('"generation":7', '"generation":-1', "graph_state.generation: must be at least 0"),
    ('"complete":true', '"complete":1', "complete: must be true or false"),
    ('"complete":true', '"complete":false', "is not complete"),
    ('00:00Z"', '00:00"', "created_at: has another form"),
    ('"catalog_digest":"[0-9a-f]', '"catalog_digest":"', "catalog_digest: has another form"),
    (r'"candidates":\["', '"candidates":["~~~","', "names candidates out of order or twice"),
    (r'"candidates":\[[^\]]*\]', '"candidates":[]', "candidates: has too few items"),
    (r'"candidates":\[[^\]]*\]', '"candidates":["x"]', "has other rows than candidates"),
    (r'"rows":\[', '"rows":[{"candidate":"x"},', "rows.0.before: is missing"),
    ('"notices"', '"more":1,"notices"', "has an unknown field"),
    ('"agent_found":true', '"agent_found":null', "rows.0.before.agent_found: must not be null"),
    ('"evidence":', '"evidence":null,"old":', "rows.0.before.evidence: must not be null"),
    ('"risk_score":[^,]*', '"risk_score":1.5', "rows.0.before.risk_score: is out of bounds"),
    ('"change":"[a-z_]+"', '"change":"sideways"', "rows.0.change: must be one of the known values"),
    ('"details_changed":', '"details_changed":null,"old":', "rows.0.details_changed: must not be null"),
    ('"agent":"', '"agent":" ', "agent: has another form"),
    ('"regression_ready":', '"regression_ready":"yes","old":', "regression_ready: must be true or false"),
    ('"profile":"strict"', '"profile":"strict","catalog_digest":"x"', "not JSON"),
]


def _reviewed(was: DataFrame, becomes: DataFrame) -> DataFrame:
    """(agent, value): each agent's candidates decided before and after the proposed manifest, as an artifact damaged by the agent's number."""
    some = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told = F.struct("decision", "reason", "tool_key", F.lit(True).alias("agent_found"), "risk_score", F.array().cast("array<struct<a:int>>").alias("evidence"), some("boolean", "is_drifted"), some("boolean", "is_unmapped"), some("boolean", "has_unbacked_edges"))
    old = was.select("agent", "pos", "ref", told.alias("before"))
    new = becomes.select("agent", "pos", "ref", told.alias("after"))
    both = old.join(new, ["agent", "pos", "ref"])
    change = decisions.change_of(F.col("before.decision"), F.col("after.decision"))
    row = F.struct(F.col("ref").alias("candidate"), "before", "after", change.alias("change"), (F.to_json("before") != F.to_json("after")).alias("details_changed"))
    rows = both.groupBy("agent", "ref").agg(F.max(F.struct("pos", row.alias("x"))).alias("m")).groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("ref", "m.x"))).alias("rows"))
    digest = lambda c, name: F.sha2(F.lit(c), 256).alias(name)
    state = F.struct(F.lit("one").alias("instance_id"), F.lit(7).alias("generation")).alias("graph_state")
    ready = F.forall("rows", lambda r: r["x"]["change"] != "unresolved").alias("regression_ready")
    value = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), F.lit("any.policy-impact").alias("kind"), F.lit("advisory").alias("mode"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), state, digest("a", "baseline_governance_digest"), digest("b", "proposed_governance_digest"), digest("c", "catalog_digest"),
            "agent", F.lit("strict").alias("profile"), F.col("rows.ref").alias("candidates"), F.lit(True).alias("complete"), F.transform("rows", lambda r: r["x"]).alias("rows"), ready, F.array().cast("array<string>").alias("notices"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select("agent", _damaged(value, _IMPACTS, F.right("agent", F.lit(9)).cast("int")).alias("value"))


@query(
    _TWO
    + f""", r as (select * from impact_ where pos % 5 <> 0), told as (select distinct agent, {_told(_IMPACTS, "cast(right(agent, 9) as int)")} as problem from candidates)
  select 'expected' as part, agent, ref, null as change, 'missing' as problem from (select distinct agent, ref from candidates) anti join (select distinct agent, ref from r) using (agent, ref)
  union all select 'refused', agent, null, null, problem from told where problem is not null
  union all select 'row', agent, ref, arg_max(change, pos), null from impact_ where agent in (select agent from told where problem is null) group by agent, ref
  union all select 'report', agent, null, bool_and(change <> 'unresolved')::varchar, null from impact_ where agent in (select agent from told where problem is null) group by agent""",
    of=AskedLens,
)
def s7_expectation_intake(x: AskedLens) -> DataFrame:
    """Reviewed comparisons written as artifacts and read back: which are refused and where, the rows of the others, and expectations that are missing."""
    path = f"{snapshots.shared_dir(x.spark)}/impacts-{uuid.uuid4().hex}"
    # Both tables of decisions are read by the artifacts and by what is expected of them.
    was, becomes = map(stored, _both(x))
    _reviewed(was, becomes).write.parquet(path)
    reports, rows, refused = decisions.read_impacts(x.spark.read.parquet(path))
    none = lambda name: F.lit(None).cast("string").alias(name)
    expected = snapshots.cut(decisions.impact(was, becomes).filter("pos % 5 <> 0"))
    missing = decisions.expectation_problems(expected, x.candidates).filter("problem = 'missing'").select(F.lit("expected").alias("part"), "agent", "ref", none("change"), "problem")
    parts = [
        refused.select(F.lit("refused").alias("part"), "agent", none("ref"), none("change"), "problem"),
        rows.select(F.lit("row").alias("part"), "agent", "ref", "change", none("problem")),
        reports.select(F.lit("report").alias("part"), "agent", none("ref"), F.col("regression_ready").cast("string").alias("change"), none("problem")),
    ]
    return reduce(DataFrame.unionByName, parts, missing)


@query("select tool_key as key, tool as name, server, read_only_hint, destructive_hint from tools where exposed")
def s8_exposed_catalog_scan(x: Lens) -> DataFrame:
    return decisions.exposed_catalog(x.graph).select("key", "name", "server", "read_only_hint", "destructive_hint")


# ---- Proposals ---------------------------------------------------------------------------

_ROWS = f""", seen as (select o.agent, o.tool_key, o.calls, least(o.would_block_calls, o.calls) as would_block_calls, s.reasons, s.agent is not null as decided from observed o left join (select agent, candidate as tool_key, reasons from scored) s using (agent, tool_key)),
obs as materialized (select agent, tool_key as ref, tool_key, case when len(coalesce(reasons, ['NOT_GRANTED'])) > 0 then 'rejected' else 'eligible' end as decision, calls, would_block_calls, list_sort(coalesce(reasons, ['NOT_GRANTED'])) as reasons from seen)"""


def _observations(x: Lens) -> DataFrame:
    """Observed usage with the reasons that the selector gives (unknown references: not granted)."""
    from palisade.operators import selector

    got = selector.rank_features(x.graph, x.candidates, evidence=False).select("agent", F.col("candidate").alias("tool_key"), "reasons")
    rows = x.observed.join(got, ["agent", "tool_key"], "left")
    reasons = F.array_sort(F.coalesce("reasons", F.array(F.lit("NOT_GRANTED"))))
    return rows.select("agent", F.col("tool_key").alias("ref"), "tool_key", F.when(F.size(reasons) > 0, "rejected").otherwise("eligible").alias("decision"), "calls", F.least("would_block_calls", "calls").alias("would_block_calls"), reasons.alias("reasons"), F.lit(True).alias("reasons_complete"))


#: What is wrong with every twelfth export: the line (n rows stand on lines 2 to n + 1) and the problem.
_EXPORT_FAULTS = [
    None, ("n + 2", "repeats an agent and ref"), ("2", "decision: must be one of the known values"), ("n + 2", "agent: is missing"), ("1", "carries more than the envelope"), ("1", "envelope: must be an object"),
    ("n + 1", "not JSON"), ("2", "calls: must be an integer"), ("2", "blocks more calls than it counts"), ("2", "has an unknown reason"), None, None,
]
_EXPORT_CASES = " ".join(f"when {i} then {{}}" for i, f in enumerate(_EXPORT_FAULTS) if f)


@query(
    _ROWS
    + f""", ex as (select *, cast(right(agent, 9) as int) % 40 as e, row_number() over (partition by cast(right(agent, 9) as int) % 40 order by agent, ref) + 1 as line from obs),
  n as (select e, count(*) as n from ex group by 1)
  select e as export, agent, ref, decision, calls, would_block_calls, array_to_string(reasons, ',') as reasons, null::bigint as line, null as problem from ex where e % 12 in (0, 10, 11)
  union all select e, null, null, null, null, null, null, case e % 12 {_EXPORT_CASES.format(*[f[0] for f in _EXPORT_FAULTS if f])} end, case e % 12 {_EXPORT_CASES.format(*[repr(f[1]) for f in _EXPORT_FAULTS if f])} end from n where e % 12 not in (0, 10, 11)"""
)
def s3_window_intake(x: Lens) -> DataFrame:
    """Forty exports, most of them with one fault: which are refused at which line, and the rows of the others."""
    e, c = F.right("agent", F.lit(9)).cast("int") % 40, F.col
    value = F.to_json(F.struct("agent", "tool_key", "decision", "calls", "would_block_calls", F.transform("reasons", F.lower).alias("reject_reasons")))
    rows = _observations(x).select(e.alias("export"), "agent", "ref", value.alias("value"))
    rows = stored(rows.withColumn("line", F.row_number().over(Window.partitionBy("export").orderBy("agent", "ref")) + 1))
    ends = rows.groupBy("export").agg(F.count("*").alias("n"), F.min_by("value", "line").alias("first"))
    fault, at_2 = c("export") % 12, c("line") == 2
    put = F.when(at_2 & (fault == 2), F.regexp_replace("value", '"decision":"[a-z]+"', '"decision":"maybe"')).when(at_2 & (fault == 7), F.regexp_replace("value", '"calls":', '"calls":" 7","old":'))
    put = put.when(at_2 & (fault == 8), F.regexp_replace("value", '"calls":[0-9]+,"would_block_calls":[0-9]+', '"calls":0,"would_block_calls":5')).when(at_2 & (fault == 9), F.regexp_replace("value", r'"reject_reasons":\[[^\]]*\]', '"reject_reasons":["nonsense"]'))
    body = rows.join(ends, "export").withColumn("value", put.when((fault == 6) & (c("line") == c("n") + 1), "{").otherwise(c("value"))).select("export", "line", "value")
    head = F.when(fault == 4, '{"envelope": {"profile": "strict"}, "agent": "a"}').when(fault == 5, '{"envelope": "strict"}').when(fault == 10, " ").otherwise('{"envelope": {"profile": "strict"}}')
    heads = ends.select("export", F.when(fault == 3, c("n") + 2).otherwise(1).alias("line"), head.alias("value"))
    more = ends.filter(fault == 1).select("export", (c("n") + 2).alias("line"), c("first").alias("value"))
    blank = ends.filter(fault == 11).select("export", F.lit(0).alias("line"), F.lit("").alias("value"))
    got = propose.read_exports(body.unionByName(heads).unionByName(more).unionByName(blank).withColumn("line", c("line").cast("long")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    fine = got.rows.select("export", "agent", "ref", "decision", "calls", "would_block_calls", F.array_join("reasons", ",").alias("reasons"), none("long", "line"), none("string", "problem"))
    texts = [none("string", n) for n in ("agent", "ref", "decision")]
    return fine.unionByName(got.refused.select("export", *texts, none("long", "calls"), none("long", "would_block_calls"), none("string", "reasons"), "line", "problem"))


@query("select event_id as id, case event_id % 5 when 0 then 'digest of another manifest' when 1 then 'another generation' when 2 then 'unknown profile' when 3 then 'window ends before it starts' else 'another instance' end as problem from events", lens=False)
def p1_envelope_check(x: Lens) -> DataFrame:
    k, digest = F.col("event_id"), F.sha2(F.lit("a"), 256)
    state = x.spark.range(1).select(digest.alias("governance_digest"), F.lit(7).cast("long").alias("generation"), F.lit("one").alias("instance_id"))
    rows = x.table("events").select(k.alias("id"), F.when(k % 5 == 0, F.sha2(F.lit("b"), 256)).otherwise(digest).alias("governance_digest"), F.when(k % 5 == 1, 8).otherwise(7).cast("long").alias("graph_generation"), F.when(k % 5 == 2, "lax").otherwise("strict").alias("profile"), F.when(k % 5 == 3, "2026-01-09T00:00:00Z").otherwise("2026-01-01T00:00:00Z").alias("window_start"), F.lit("2026-01-08T00:00:00+00:00").alias("window_end"), F.when(k % 5 == 4, "two").otherwise("one").alias("graph_instance_id"), F.lit(None).cast("string").alias("instance_id"))
    return propose.envelope_problems(rows, state, keep=("id",))


@query("select event_id, ts as at from events where event_id % 3 = 0", lens=False)
def p2_instant_parse(x: Lens) -> DataFrame:
    shape = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-00:00'"))
    got = x.table("events").select("event_id", propose.instant(shape).alias("at")).filter("at is not null")
    return got.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(_ROWS + " select agent, ref, 'would_block above calls' as problem from obs where calls > 0 and calls % 2 = 0 union all select agent, ref, case when decision = 'rejected' then null end from obs where false")
def p3_row_check(x: Lens) -> DataFrame:
    rows = _observations(x).withColumn("would_block_calls", F.when((F.col("calls") % 2 == 0) & (F.col("calls") > 0), F.col("calls") + 1).otherwise(F.col("would_block_calls")))
    return rows.select("agent", "ref", propose.row_problem().alias("problem")).filter("problem is not null")


@query("select distinct agent from observed where agent like '%7'")
def p4_unknown_agents(x: Lens) -> DataFrame:
    return propose.unknown_agents(x.observed, x.graph.agents.select(F.col("id").alias("agent")).filter("agent not like '%7'"))


@query("select agent, tool_key, calls as used, calls = 0 as zero from observed")
def p5_usage_totals(x: Lens) -> DataFrame:
    return propose.usage_totals(_observations(x))


_BUCKETS = _ROWS + """, bucketed as materialized (select o.agent, o.ref, o.would_block_calls, o.reasons, case when list_contains(reasons, 'DENY_VIOLATION') or list_contains(reasons, 'DENY_GOVERNED') then 'conflict' when would_block_calls < 1 then 'dropped' when reasons = ['NOT_GRANTED'] and c.agent is null then 'addition' when reasons = ['NOT_GRANTED'] then 'granted' else 'not_grant_shaped' end as bucket
  from obs o left join can_call c on c.agent = o.agent and c.tool_key = o.ref where decision = 'rejected')"""


def _buckets(x: Lens) -> DataFrame:
    return propose.buckets(_observations(x), x.graph.can_call, least=1)


@query(_BUCKETS + " select agent, ref, would_block_calls, bucket from bucketed")
def p6_buckets(x: Lens) -> DataFrame:
    return _buckets(x).select("agent", "ref", "would_block_calls", "bucket")


@query("select agent, tool_key from can_call semi join observed o using (agent, tool_key) where exists (select 1 from observed p where p.agent = can_call.agent and p.tool_key = can_call.tool_key and p.calls = 0)")
def p7_removals(x: Lens) -> DataFrame:
    return propose.removals(x.graph.can_call, propose.usage_totals(_observations(x)))


@query(_BUCKETS + " select bucket, agent, ref, row_number() over (partition by bucket order by case when bucket = 'conflict' then 0 else -would_block_calls end, agent, ref) as rank from bucketed")
def p8_ordering(x: Lens) -> DataFrame:
    return propose.ranked(_buckets(x)).select("bucket", "agent", "ref", "rank")


@query(_BUCKETS + """, d as (select distinct q.agent, t.tool_key, t.resource, t.policy from bucketed q join tool_deny t on t.tool_key = q.ref where bucket = 'addition'),
  v as (select agent, tool_key, bool_or(not exists (select 1 from exceptions e where e.agent = d.agent and e.tool_key = d.tool_key and e.policy = d.policy and (e.resource is null or e.resource = d.resource))) as violation from d group by 1, 2)
  select b.agent, b.ref, case when v.violation is not null then 'conflict' when f.tool_key is null or f.is_drifted or f.is_unmapped then 'not_grant_shaped' else 'addition' end as bucket,
    case when f.tool_key is null then 'TOOL_NOT_FOUND' when v.violation then 'DENY_VIOLATION' when v.violation is not null then 'DENY_GOVERNED' when f.is_drifted then 'DRIFTED' when f.is_unmapped then 'UNMAPPED' else 'NOT_GRANTED' end as reason
  from bucketed b left join facts f on f.tool_key = b.ref left join v on v.agent = b.agent and v.tool_key = b.ref where b.bucket = 'addition'""")
def p9_revalidate(x: Lens) -> DataFrame:
    return propose.revalidate(_buckets(x).filter("bucket = 'addition'"), x.graph).select("agent", "ref", "bucket", "reason")


@query("select c_name as name, case c_custkey % 3 when 0 then 'exact' when 1 then 'revalidated' else 'unverified' end as status from customer", lens=False)
def p10_provenance_status(x: Lens) -> DataFrame:
    k = F.col("c_custkey")
    rows = x.table("customer").select(F.col("c_name").alias("name"), (k % 3 == 2).alias("absent"), F.sha2("c_name", 256).alias("governance_digest"), F.when(k % 3 == 0, k).cast("long").alias("graph_generation"), F.col("c_name").alias("graph_instance_id"), F.lit(None).cast("string").alias("instance_id"))
    return rows.select("name", propose.provenance_of(F.col("absent")).alias("status"))


@query(_BUCKETS + ", r as (select bucket, row_number() over (partition by bucket order by case when bucket = 'conflict' then 0 else -would_block_calls end, agent, ref) as rank from bucketed) select bucket, rank, 'note' as field from r where rank % 4 = 0")
def p11_output_check(x: Lens) -> DataFrame:
    rows = propose.ranked(_buckets(x)).withColumn("note", F.when(F.col("rank") % 4 == 0, "use password=hunter2hunter2").otherwise(F.col("note")))
    return propose.output_problems(rows)


# ---- Control plans: one per order; line items are nodes, line numbers their order ----------


class PlanLens(StoredLens):
    @cached_property
    def plans(self) -> control.Plans:
        """The plan tables, each written to the shared folder once, as several steps of a query read them."""
        p = self._plans
        return control.Plans(stored(p.plans), stored(p.principals), stored(p.nodes), stored(p.edges))

    @property
    def _plans(self) -> control.Plans:
        supplier = self.table("supplier").select("s_suppkey", "s_name")
        li = self.table("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        li = li.select("l_orderkey", "l_linenumber", "l_quantity", F.concat("s_name", F.lit("::part-"), F.col("l_partkey").cast("string")).alias("tool_key"))
        run, n = F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber")
        name = lambda c: F.concat(F.lit("n"), c.cast("string"))
        last = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"), F.first("l_orderkey").alias("k"))
        body = li.select(run, name(n).alias("node"), F.lit("agent").alias("kind"), F.lit(True).alias("agent_call"), (F.col("l_quantity").cast("long") % 5).alias("invocations"), (F.col("l_quantity").cast("long") % 3).alias("parallelism"), n.alias("pos"))
        none, no = F.lit(None).cast("long"), F.lit(False)
        ends = last.select(run, F.lit("start").alias("node"), F.lit("start").alias("kind"), no.alias("agent_call"), none.alias("invocations"), none.alias("parallelism"), F.lit(0).alias("pos"))
        ends = ends.unionByName(last.filter("l_orderkey % 12 <> 0").select(run, F.lit("end").alias("node"), F.lit("end").alias("kind"), no.alias("agent_call"), none.alias("invocations"), none.alias("parallelism"), F.lit(99).alias("pos")))
        # Every twentieth order key loops back from its last node; an edge out of node 3 is missing in some.
        chain = li.filter("not (l_linenumber = 3 and l_orderkey % 16 = 0)").join(last.select("l_orderkey", "m"), "l_orderkey").select(run, name(n).alias("source"), F.when(n == F.col("m"), "end").otherwise(name(n + 1)).alias("target"), F.lit("next").alias("kind"), F.lit("code").alias("decided_by"), none.alias("fan_out"), n.alias("pos"))
        first = last.select(run, F.lit("start").alias("source"), F.lit("n1").alias("target"), F.lit("fanout").alias("kind"), F.when(F.col("l_orderkey") % 8 == 0, "model").otherwise("code").alias("decided_by"), F.when(F.col("l_orderkey") % 24 != 0, 2).cast("long").alias("fan_out"), F.lit(0).alias("pos"))
        loops = last.filter("l_orderkey % 20 = 0").select(run, name(F.col("m")).alias("source"), F.lit("n1").alias("target"), F.lit("retry").alias("kind"), F.lit("model").alias("decided_by"), none.alias("fan_out"), F.lit(98).alias("pos"))
        return control.Plans(
            plans=last.select(run, F.lit(8).cast("long").alias("max_calls"), F.lit(1).cast("long").alias("max_parallel")),
            principals=li.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(run, F.col("c_name").alias("principal"), F.col("tool_key").alias("tool")).distinct(),
            nodes=body.unionByName(ends),
            edges=chain.unionByName(first).unionByName(loops),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """(run_id, value): the plans as JSON."""
        p = self.plans
        node = F.struct(F.col("node").alias("id"), "kind", F.array().cast("array<string>").alias("principals"), "agent_call", F.col("invocations").alias("max_invocations"), F.col("parallelism").alias("max_parallelism"))
        edge = F.struct(F.col("source").alias("from"), F.col("target").alias("to"), "kind", "decided_by", F.col("fan_out").alias("max_fan_out"))
        who = p.principals.groupBy("run_id", "principal").agg(F.collect_list("tool").alias("tools")).groupBy("run_id").agg(F.collect_list(F.struct(F.col("principal").alias("id"), F.col("tools").alias("candidate_tools"))).alias("who"))
        whole = p.nodes.groupBy("run_id").agg(F.collect_list(node).alias("nodes")).join(p.edges.groupBy("run_id").agg(F.collect_list(edge).alias("edges")), "run_id").join(who, "run_id", "left")
        principals = F.coalesce("who", F.array().cast("array<struct<id:string,candidate_tools:array<string>>>"))
        return whole.select("run_id", F.to_json(F.struct("run_id", principals.alias("principals"), "nodes", "edges", F.struct(F.lit(8).alias("maximum_agent_calls"), F.lit(1).alias("maximum_parallelism")).alias("limits"))).alias("value"))


_PLANS = """,
pl as materialized (select l_orderkey as k, l_orderkey::varchar as run_id, max(l_linenumber) as m from lineitem group by 1, 2),
pn as materialized (select l_orderkey::varchar as run_id, 'n' || l_linenumber as node, 'agent' as kind, l_linenumber as pos, l_quantity::bigint % 5 as invocations, l_quantity::bigint % 3 as parallelism from lineitem
  union all select run_id, 'start', 'start', 0, null, null from pl union all select run_id, 'end', 'end', 99, null, null from pl where k % 12 <> 0),
pe as materialized (select run_id, 'n' || l_linenumber as source, case when l_linenumber = m then 'end' else 'n' || (l_linenumber + 1) end as target, 'next' as kind, 'code' as decided_by, null::bigint as fan_out from lineitem join pl on k = l_orderkey where not (l_linenumber = 3 and k % 16 = 0)
  union all select run_id, 'start', 'n1', 'fanout', case when k % 8 = 0 then 'model' else 'code' end, case when k % 24 <> 0 then 2 end from pl union all select run_id, 'n' || m, 'n1', 'retry', 'model', null from pl where k % 20 = 0)"""


def plan_query(sql: str | None = None):
    def add(f):
        def run(x: Lens) -> DataFrame:
            return f(PlanLens(x.spark, x.sf_dir))

        run.__name__ = f.__name__
        return query(_PLANS + sql if sql else None)(run)

    return add


_REACH = """, {name} as materialized (with recursive r(run_id, node) as (select run_id, '{seed}' from pl {seeds} union select e.run_id, e.{to} from r join pe e on e.run_id = r.run_id and e.{frm} = r.node) select * from r)"""
_FORWARD = _REACH.format(name="fw", seed="start", seeds="", frm="source", to="target")
_BACKWARD = _REACH.format(name="bw", seed="end", seeds="where k % 12 <> 0", frm="target", to="source")


#: Ways to damage a plan: what is found in its text, what takes its place ($1 is what stays), and the problem told (None: still fine).
_N1 = r'("id":"n1","kind":"agent","principals":)(\[[^\]]*\])'
_DAMAGE = [
    ("$", "", None),
    ('"maximum_agent_calls":8', '"maximum_agent_calls":"8"', "limits.maximum_agent_calls: must be an integer"),
    ('"maximum_agent_calls":8', '"maximum_agent_calls":null', "limits.maximum_agent_calls: must not be null"),
    ('"maximum_agent_calls":8', '"maximum_agent_calls":true', "limits.maximum_agent_calls: must be an integer"),
    ('"maximum_agent_calls":8', '"maximum_agent_calls":8.5', "limits.maximum_agent_calls: must be an integer"),
    ('"maximum_agent_calls":8', '"maximum_agent_calls":8.0', None),
    ('"maximum_agent_calls":8', '"maximum_agent_calls":0', "limits.maximum_agent_calls: must be at least 1"),
    ('"maximum_agent_calls":8,', "", "limits.maximum_agent_calls: is missing"),
    ('"maximum_cycles":0', '"maximum_cycles":1', "limits.maximum_cycles: must be one of the known values"),
    ('"maximum_cycles":0', '"maximum_cycles":false', "limits.maximum_cycles: must be an integer"),
    ('"limits":[{][^}]*[}]', '"limits":{}', "limits.maximum_agent_calls: is missing"),
    ('"limits":[{][^}]*[}]', '"limits":[]', "limits: must be an object"),
    ('"limits":[{][^}]*[}]', '"limits":null', "limits: must not be null"),
    ('"schema_version":1', '"schema_version":2', "schema_version: must be one of the known values"),
    ('"schema_version":1', '"schema_version":true', "schema_version: must be an integer"),
    ('"schema_version":1', '"schema_version":1.0,"note":{"any":[1,null]}', None),
    ('"kind":"any.control-plan"', '"kind":"any.plan"', "kind: has another form"),
    ('"kind":"any.control-plan"', '"kind":"any.control-plan","kind":"any.control-plan"', "not JSON"),
    ('"version":"1"', '"version":""', "producer.version: has a length out of bounds"),
    ('"name":"maker"', '"name":"Bearer=abc"', None),
    ('"name":"maker"', '"name":"token=abcdef"', "producer.name: must not hold a credential"),
    ('"run_id":"', '"run_id":"a b', "run_id: has another form"),
    ('"run_id":"[0-9]+"', '"run_id":7', "run_id: must be text"),
    ('"principals":.*,"nodes"', '"principals":[],"nodes"', "principals: has too few items"),
    ('"candidate_tools":\\[[^\\]]*\\]', '"candidate_tools":[]', "principals.0.candidate_tools: has too few items"),
    ('"candidate_tools":\\["', '"candidate_tools":["a","', "principals.0.candidate_tools: must be server::tool keys"),
    ('"candidate_tools":\\[', '"candidate_tools":["a::b","a::b",', "principals.0.candidate_tools: names a tool twice"),
    ('"candidate_tools":\\[', '"candidate_tools":[null,', "principals.0.candidate_tools.0: must be text"),
    ('"kind":"start"', '"kind":"begin"', "nodes.0.kind: must be one of the known values"),
    ('"kind":"start"', '"kind":"agent"', "nodes.0: kind and agent_call disagree"),
    ('"kind":"start"', '"kind":"start","max_invocations":2', "nodes.0: has bounds but calls no agent"),
    ('"kind":"start"', '"kind":"start","max_invocations":null', "nodes.0.max_invocations: must not be null"),
    ('"kind":"start"', '"kind":"validator"', "nodes.0: validators, and only they, have a scope"),
    ('"kind":"start"', '"kind":"validator","validator_scope":"workspace_result"', None),
    ('"kind":"start"', '"kind":"router","validator_scope":"workspace_result"', "nodes.0: validators, and only they, have a scope"),
    ('"id":"start",', "", "nodes.0.id: is missing"),
    ('"id":"start"', '"id":"st art"', "nodes.0.id: has another form"),
    ('"id":"start"', '"id":["start"]', "nodes.0.id: must be text"),
    ('"id":"start"', '"id":"n1"', "names a node twice"),
    ('"agent_call":false', '"agent_call":"false"', "nodes.0.agent_call: must be true or false"),
    ('"agent_call":false', '"agent_call":0', "nodes.0.agent_call: must be true or false"),
    (_N1, "$1null", "nodes.1.principals: must not be null"),
    (_N1, "$1[]", "nodes.1: calls an agent without a principal"),
    (_N1, '$1["nobody"]', "a node names an undeclared principal"),
    (_N1, '$1["nobody","nobody"]', "nodes.1: names a principal twice"),
    (_N1, '$1{"a":1}', "nodes.1.principals: must be a list"),
    (r'("id":"n1".*?),"timeout_seconds":9', "$1", "nodes.1: calls an agent without all bounds"),
    (r'("id":"n1".*?"max_parallelism":)[0-9]+', "$177", "nodes.1: runs more at once than in all"),
    (r'("id":"n1".*?"max_invocations":)[0-9]+', "$1-1", "nodes.1.max_invocations: must be at least 1"),
    ('"from":"start"', '"from":""', "edges.0.from: has a length out of bounds"),
    ('"from":"start",', "", "edges.0.from: is missing"),
    ('"to":"n1","kind":"fanout"', '"to":"n1","kind":"jump"', "edges.0.kind: must be one of the known values"),
    ('"decided_by":"(?:code|model)"', '"decided_by":"dice"', "edges.0.decided_by: must be one of the known values"),
    ("^", "[", "not JSON"),
    ("^.*$", "[1]", "must be an object"),
    ("^.*$", "NaN", "not JSON"),
]


def _typed_plans(x: PlanLens) -> DataFrame:
    """(k, value): each order as a plan that the contract allows, then damaged by its key."""
    p, k = x.plans, F.col("run_id").cast("long")
    node = F.struct("pos", F.struct(F.col("node").alias("id"), "kind", F.when(F.col("agent_call"), F.array("who")).otherwise(F.array().cast("array<string>")).alias("principals"), "agent_call", (F.col("invocations") + 1).alias("max_invocations"), F.least(F.col("parallelism") + 1, F.col("invocations") + 1).alias("max_parallelism"), F.when(F.col("agent_call"), 9).alias("timeout_seconds")).alias("x"))
    kind = F.when(F.col("kind") == "next", "always").when(F.col("kind") == "retry", "fallback").otherwise(F.col("kind"))
    edge = F.struct("pos", F.struct(F.col("source").alias("from"), F.col("target").alias("to"), kind.alias("kind"), "decided_by", F.col("fan_out").alias("max_fan_out")).alias("x"))
    who = p.principals.groupBy("run_id", F.col("principal").alias("who")).agg(F.sort_array(F.collect_set(F.regexp_replace("tool", r"\s", "_"))).alias("tools"))
    named = spread(p.nodes, "run_id").join(who.select("run_id", "who"), "run_id")
    listed = lambda rows, one, name: rows.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda e: e["x"]).alias(name))
    whole = listed(named, node, "nodes").join(listed(p.edges, edge, "edges"), "run_id").join(who, "run_id")
    one = F.lit(1)
    limits = F.struct(F.lit(8).alias("maximum_agent_calls"), one.alias("maximum_parallelism"), F.lit(0).alias("maximum_cycles"))
    value = F.to_json(F.struct(one.alias("schema_version"), F.lit("any.control-plan").alias("kind"), "run_id", F.struct(F.lit("maker").alias("name"), F.lit("1").alias("version")).alias("producer"), F.array(F.struct(F.col("who").alias("id"), F.col("tools").alias("candidate_tools"))).alias("principals"), "nodes", "edges", limits.alias("limits")))
    return whole.select(k.alias("k"), "run_id", _damaged(value, _DAMAGE, k).alias("value"))


_TOLD = _told(_DAMAGE, "k")


@plan_query(f""", twice as (select distinct run_id from (select run_id from pn group by run_id, node having count(*) > 1)),
  firsts as (select distinct run_id from pn where node = 'n1'),
  told as (select k, run_id, case when ({_TOLD} like 'nodes.1%' or {_TOLD} in ('names a node twice', 'a node names an undeclared principal')) and run_id not in (from firsts) then null else {_TOLD} end as problem from pl join orders on k = o_orderkey),
  q as (select k, case when coalesce(problem, 'a node names') like 'a node names%' and run_id in (from twice) then 'names a node twice' else problem end as problem from told)
  select k, problem, null::bigint as nodes, null::bigint as edges, null::bigint as calls, null::bigint as max_calls from q where problem is not null
  union all select k, null, n, e, c, 8 from q join (select run_id, count(*) as n, sum(invocations + 1)::bigint as c from pn group by 1) a on a.run_id = k::varchar join (select run_id, count(*) as e from pe group by 1) b on b.run_id = k::varchar where problem is null""")
def s4_plan_intake(x: PlanLens) -> DataFrame:
    """Every order as a plan, damaged in one of the ways of _DAMAGE: what is refused, why and where, and what the others hold."""
    got, refused = control.read_plans(_typed_plans(x).select("k", "value"))
    sums = got.nodes.groupBy("run_id").agg(F.count("*").alias("nodes"), F.sum("invocations").alias("calls"))
    fine = got.plans.join(sums, "run_id").join(got.edges.groupBy("run_id").agg(F.count("*").alias("edges")), "run_id")
    none = F.lit(None).cast("long")
    fine = fine.select(F.col("run_id").cast("long").alias("k"), F.lit(None).cast("string").alias("problem"), "nodes", "edges", "calls", F.col("max_calls"))
    return refused.select("k", "problem", none.alias("nodes"), none.alias("edges"), none.alias("calls"), none.alias("max_calls")).unionByName(fine)


@plan_query(" select run_id, 'duplicate_node' as code, count(*) as n from (select run_id, node from pn group by 1, 2 having count(*) > 1) group by 1")
def c1_plan_field_checks(x: PlanLens) -> DataFrame:
    return control.field_findings(x.plans).groupBy("run_id", "code").agg(F.count("*").alias("n"))


#: Names put into rows in turn, those that a plan must not carry first, and values, absolute paths first.
_BARRED = (
    "api_key body command commands credential credentials env gate_commands headers memory model_selector output outputs password patch prompt prompts repo_root repository_path secret stderr stdout token worktree "
    "my_api_key_2 my_command_2 my_credential_2 my_memory_body_2 my_model_selector_2 my_output_2 my_password_2 my_patch_2 my_prompt_2 my_secret_2 my_stderr_2 my_stdout_2 my_token_2 Headers STDOUT"
).split()
_NAMED = [*_BARRED, *"content messages environment bodies memories worktrees notes id".split()]
_PATHS = ["/etc/x", r"\\\\host\\x", "C:/x", r"d:\\x", "a/b", "~/x", "C:x", ""]


@query(
    f"""with c as (select {_NAMED!r}[(conv_id * 7 + turn) % {len(_NAMED)} + 1] as name, (conv_id * 7 + turn) % {len(_NAMED)} < {len(_BARRED)} as barred, (conv_id + turn) % {len(_PATHS)} < 4 as path, text, coalesce({_SHAPED}, false) as shaped from conversations)
  select code, subject, count(*) as n from (select 'forbidden_field' as code, name as subject from c where barred union all select 'absolute_path', name from c where path
  union all select 'credential_value', 'text' from c where shaped union all select 'absolute_path', 'text' from c where regexp_matches(text, '^(?:/|\\\\\\\\|[A-Za-z]:[\\\\/])')) group by 1, 2""",
    lens=False,
)
def c2_body_free_check(x: Lens) -> DataFrame:
    """Plans as JSON, and each conversation row as JSON with one name and one value put in, up to eleven levels down."""
    i, j = (F.col("conv_id") * 7 + F.col("turn")) % len(_NAMED), (F.col("conv_id") + F.col("turn")) % len(_PATHS)
    put = F.concat(F.lit('{"'), F.element_at(F.array(*map(F.lit, _NAMED)), (i + 1).cast("int")), F.lit('": "'), F.element_at(F.array(*map(F.lit, _PATHS)), (j + 1).cast("int")), F.lit('"}'))
    said = F.to_json(F.struct("conv_id", "turn", F.struct("role", "text").alias("said")))
    levels = (F.col("turn") % 11).cast("int")
    rows = x.table("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("run_id"), F.concat(F.repeat(F.lit("["), levels), said, F.lit(", "), put, F.repeat(F.lit("]"), levels)).alias("value"))
    rows = rows.withColumn("value", F.concat(F.lit("["), "value", F.lit("]")))
    return control.body_findings(PlanLens(x.spark, x.sf_dir).documents.union(rows)).groupBy("code", "subject").agg(F.count("*").alias("n"))


@plan_query(" select run_id, 'end_count' as code, '0' as subject from pl where k % 12 = 0")
def c3_start_end_count(x: PlanLens) -> DataFrame:
    return control.start_end(x.plans)


@plan_query(" select distinct run_id, 'unknown_node' as code, node as subject from (select run_id, source as node from pe union select run_id, target from pe) anti join pn using (run_id, node)")
def c4_unknown_node(x: PlanLens) -> DataFrame:
    return control.unknown_nodes(x.plans)


@plan_query(_FORWARD + " select run_id, 'unreachable' as code, node as subject from pn anti join fw using (run_id, node)")
def c5_unreachable(x: PlanLens) -> DataFrame:
    return control.unreachable(x.plans)


@plan_query(_BACKWARD + " select run_id, 'no_terminal_path' as code, node as subject from pn semi join (select run_id from pl where k % 12 <> 0) using (run_id) anti join bw using (run_id, node)")
def c6_no_terminal_path(x: PlanLens) -> DataFrame:
    return control.no_terminal_path(x.plans)


#: What each node leads to along edges out of a plan's nodes; a node stays after peeling if a node on a loop leads to it.
_CYCLES = """, cl as materialized (with recursive r(run_id, a, b) as (select run_id, source, target from pe semi join pn on pn.run_id = pe.run_id and pn.node = pe.source union select r.run_id, r.a, e.target from r join pe e on e.run_id = r.run_id and e.source = r.b) select * from r),
  looped as materialized (select run_id, a as m from cl where a = b), cyc as materialized (select distinct c.run_id, c.b as node from cl c join looped l on l.run_id = c.run_id and l.m = c.a semi join pn on pn.run_id = c.run_id and pn.node = c.b)"""


@plan_query(_CYCLES + " select run_id, 'cycle' as code, node as subject from cyc")
def c7_cycle(x: PlanLens) -> DataFrame:
    return control.cycles(x.plans)


@plan_query(" select run_id, 'model_fanout_unbounded' as code, 'start>n1' as subject from pl where k % 24 = 0")
def c8_model_fanout_unbounded(x: PlanLens) -> DataFrame:
    return control.unbounded_fanout(x.plans)


@plan_query(" select run_id, 'call_bound' as code, sum(invocations)::bigint::varchar as subject from pn group by 1 having sum(invocations) > 8")
def c9_call_bound(x: PlanLens) -> DataFrame:
    return control.call_bound(x.plans)


@plan_query(" select run_id, 'parallel_bound' as code, max(parallelism)::varchar as subject from pn group by 1 having max(parallelism) > 1")
def c10_parallel_bound(x: PlanLens) -> DataFrame:
    return control.parallel_bound(x.plans)


_ASKED = """, asked3 as (select distinct l_orderkey::varchar as run_id, c_name as principal, li.tool_key from li join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey),
  d3 as (select distinct a.principal as agent, t.tool_key, t.resource, t.policy from asked3 a join tool_deny t using (tool_key)), w3 as (select distinct agent, tool_key from d3),
  decided3 as materialized (select a.run_id, a.principal, a.tool_key, c.agent is not null and w3.agent is null and not f.is_drifted and not f.is_unmapped as fine from asked3 a join facts f using (tool_key) left join can_call c on c.agent = a.principal and c.tool_key = a.tool_key left join w3 on w3.agent = a.principal and w3.tool_key = a.tool_key)"""


@plan_query(_ASKED + " select run_id, principal, tool_key, fine from decided3")
def c11_principal_decisions(x: PlanLens) -> DataFrame:
    got = control.principal_decisions(x.plans, x.graph)
    return got.select("run_id", "principal", "tool_key", F.col("reason").isNull().alias("fine"))


_FLOWS = _ASKED + """, acts as materialized (select distinct n.run_id, n.node, a.tool_key, d.mode, d.uri from pn n join decided3 a on a.run_id = n.run_id and a.fine join data_access d using (tool_key) where n.kind = 'agent'),
  dist as materialized (with recursive r(run_id, seed, node, depth) as (select distinct run_id, node, node, 0 from acts where mode = 'READS' union select r.run_id, r.seed, e.target, r.depth + 1 from r join pe e on e.run_id = r.run_id and e.source = r.node where r.depth < 12) select run_id, seed, node, min(depth) as depth from r where depth > 0 and seed <> node group by 1, 2, 3),
  flows as materialized (select d.run_id, d.seed as reader, d.node as writer, d.depth, r.tool_key as read_tool, r.uri as read_uri, w.tool_key as write_tool, w.uri as write_uri from dist d join acts r on r.run_id = d.run_id and r.node = d.seed and r.mode = 'READS' join acts w on w.run_id = d.run_id and w.node = d.node and w.mode = 'WRITES')"""


def _flows(x: PlanLens, paths: bool = False, decided: DataFrame | None = None) -> DataFrame:
    agents = x.plans.nodes.filter("kind = 'agent'").select("run_id", "node").join(x.plans.principals.select("run_id", "principal").distinct(), "run_id")
    return control.exposures(x.plans, agents, x.graph, control.principal_decisions(x.plans, x.graph) if decided is None else decided, paths)


@plan_query(_FLOWS + " select run_id, reader, writer, depth, read_tool, read_uri, write_tool, write_uri from flows")
def c12_exposures(x: PlanLens) -> DataFrame:
    return _flows(x)


@plan_query(_FLOWS + " select distinct run_id, reader, writer, depth + 1 as hops from flows")
def c13_witness_path(x: PlanLens) -> DataFrame:
    return _flows(x, paths=True).select("run_id", "reader", "writer", F.size("path").alias("hops")).distinct()


@plan_query(_FLOWS + " select run_id, count(*) as pairs, least(count(*), 2) as shown, count(*) > 2 as truncated from flows group by 1")
def c14_exposure_cap(x: PlanLens) -> DataFrame:
    got = control.capped(_flows(x), x.plans.nodes, most=2)
    return got.groupBy("run_id", "pairs", "truncated").agg(F.count("*").alias("shown"))


_FAULTS = """, faults as materialized (select run_id from pl where k % 12 = 0 or k % 24 = 0 union select run_id from pn group by run_id having sum(invocations) > 8 or max(parallelism) > 1 union select run_id from (select run_id, node from pn group by 1, 2 having count(*) > 1)
  union select run_id from (select run_id, source as node from pe union select run_id, target from pe) anti join pn using (run_id, node) union select run_id from pn anti join fw using (run_id, node) union select run_id from pn anti join bw using (run_id, node)
  union select run_id from cyc union select run_id from decided3 where not fine union select run_id from flows)"""


@plan_query(_FLOWS + _FORWARD + _BACKWARD + _CYCLES + _FAULTS + " select run_id, case when run_id in (select run_id from faults) then 'advisory_warn' else 'advisory_allow' end as decision from pl")
def c15_plan_decision(x: PlanLens) -> DataFrame:
    decided = stored(control.principal_decisions(x.plans, x.graph))
    findings = control.lint(x.plans).unionByName(control.field_findings(x.plans))
    return control.plan_decisions(x.plans, findings, decided, _flows(x, decided=decided))


# ---- Reviews: one report per day of events ---------------------------------------------------

_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_REVIEW = """ev as (select event_id, strftime(ts, '%Y-%m-%d') as report, 'c' || (user_id % 7) as candidate, case event_type when 'click' then 'accepted' when 'view' then 'open' when 'purchase' then 'rejected' else 'deferred' end as disposition, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by event_id) as seq from events),
  chain as (select *, coalesce(lag(disposition) over (partition by report, candidate order by seq), 'open') as from_disposition from ev)"""


class ReviewLens(StoredLens):
    @cached_property
    def events(self) -> DataFrame:
        from pyspark.sql import Window

        e = F.col("event_type")
        rows = self.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("report"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("candidate"), F.when(e == "click", "accepted").when(e == "view", "open").when(e == "purchase", "rejected").otherwise("deferred").alias("disposition"))
        rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("report").orderBy("event_id")))
        before = F.lag("disposition", 1, "open").over(Window.partitionBy("report", "candidate").orderBy("seq"))
        return rows.withColumns({"from_disposition": before, "reviewer": F.lit("ann")})

    @cached_property
    def cases(self) -> DataFrame:
        return self.events.select("report").distinct().crossJoin(F.broadcast(self.spark.range(8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate"))))


def review_query(sql: str | None = None):
    def add(f):
        def run(x: Lens) -> DataFrame:
            return f(ReviewLens(x.spark, x.sf_dir))

        run.__name__ = f.__name__
        return query("with " + _REVIEW + sql if sql else None, lens=False)(run)

    return add


#: Ways in which reports are damaged, by the last digit of their day, and what the intake says of it.
_BAD_REPORTS = {
    0: "candidates.0.pattern_version: must be an integer", 1: "candidates.0.tool_key: has another form", 2: "candidates: names a candidate twice", 3: "candidates: is missing", 4: "candidates.0.run_id: must not be null",
    5: "candidates.0.artifact_digest: is missing", 6: "schema_version: must be one of the known values",
}
_BAD_NOTES = {
    0: "events.0: has an unknown field", 1: "names an unknown report", 2: "events.0.reviewer: begins or ends with white space", 3: "events.0.from_disposition: must be one of the known values", 4: "events.0.recorded_at: has another form",
    5: "events.0.sequence: must be an integer", 6: "events.0.candidate_id: is another candidate's",
}


def _told_by_day(rows: str, bad: dict[int, str]) -> str:
    said = " ".join("when {} then '{}'".format(k, why.replace("'", "''")) for k, why in bad.items())
    return f" select report as day, case when k in ({', '.join(map(str, bad))}) then 0 else count(*) end as taken, case k {said} end as problem from (select {rows}, right(report, 1)::int as k from ev) group by report, k"


def _identity(day: str) -> list:
    return [F.col(day).alias("run_id"), F.lit("p").alias("pattern_id"), F.lit(1).cast("long").alias("pattern_version"), F.concat(F.lit("s::"), F.col("candidate")).alias("tool_key"), F.lit("sha256:" + "d" * 64).alias("artifact_digest")]


def _by_day(taken: DataFrame, refused: DataFrame) -> DataFrame:
    """(day, taken, problem): rows taken per day, and the days that were refused, once for each problem."""
    return taken.groupBy(F.col("run_id").alias("day")).agg(F.count("*").alias("taken")).select("day", "taken", F.lit(None).cast("string").alias("problem")).unionByName(refused.select("day", F.lit(0).cast("long").alias("taken"), "problem").distinct())


@review_query(_told_by_day("distinct report, candidate", _BAD_REPORTS))
def s5_review_intake(x: ReviewLens) -> DataFrame:
    k = F.right("day", F.lit(1)).cast("int")
    rows = x.events.select(F.col("report").alias("day"), "candidate").distinct().select("day", F.struct(*_identity("day"), F.lit("dropped").alias("extra")).alias("c"))
    each = rows.groupBy("day").agg(F.array_sort(F.collect_list("c")).alias("c")).withColumn("c", F.when(k == 2, F.concat("c", F.slice("c", 1, 1))).otherwise(F.col("c")))
    text = F.to_json(F.struct(F.when(k == 6, 2).otherwise(1).alias("schema_version"), F.lit("made.review-candidates").alias("kind"), F.when(k != 3, F.col("c")).alias("candidates")))
    for i, (found, put) in {0: ('"pattern_version":1', '"pattern_version":"1"'), 1: ("::", "."), 4: ('"run_id":"[^"]*"', '"run_id":null'), 5: ('"artifact_digest":"[^"]*",', "")}.items():
        text = F.when(k == i, F.regexp_replace(text, found, put)).otherwise(text)
    return _by_day(*review.read_reports(each.select("day", F.encode(text, "UTF-8").alias("content"))))


#: Events that one document of annotations holds at most, some 4 MB: a tenth of what the contract allows.
MOST_TOLD = 10_000


@review_query(_told_by_day("report", _BAD_NOTES))
def s6_annotation_intake(x: ReviewLens) -> DataFrame:
    k = F.right("day", F.lit(1)).cast("int")
    identify = review.candidate_id(_NAMESPACE, 1, "made.review-candidates")
    rows = x.events.withColumn("day", F.col("report")).select("*", *_identity("day")).withColumn("candidate_id", identify)
    event = F.struct(
        F.col("seq").alias("sequence"), F.when(k == 6, F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8")).otherwise(F.col("candidate_id")).alias("candidate_id"), F.struct(*review.FIELDS).alias("candidate"),
        F.when(k == 3, "closed").otherwise(F.col("from_disposition")).alias("from_disposition"), "disposition", F.when(k == 2, "ann ").otherwise(F.col("reviewer")).alias("reviewer"),
        F.when(k == 4, "2026-01-01T00:00:00+01:00").otherwise("2026-01-01T00:00:00.5Z").alias("recorded_at"), F.when(k == 0, "x").alias("further"),
    )
    # A day's events are told in as many documents as the contract's limit of bytes asks for.
    each = rows.groupBy("day", F.floor((F.col("seq") - 1) / MOST_TOLD).alias("part")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    source = F.struct(F.lit(1).alias("schema_version"), F.lit("made.review-candidates").alias("kind"), F.concat(F.lit("sha256:"), F.sha2("day", 256)).alias("source_report_digest"))
    text = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("made.review-annotations").alias("kind"), source.alias("source"), "events"))
    text = F.when(k == 5, F.regexp_replace(text, '"sequence":([0-9]+)', '"sequence":$1.5')).otherwise(text)
    known = x.cases.filter("report not like '%1'").select(F.sha2("report", 256).alias("report"))
    return _by_day(*review.read_annotations(each.select("day", F.encode(text, "UTF-8").alias("content")), known, identify))


#: UUIDv5: the first 128 bits of a SHA-1, with the version and the variant set.
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_HASHED = f"sha1(unhex('{_NAMESPACE.replace('-', '')}') || encode('[1,\"review\",\"' || report || '\",\"p\",1,\"' || candidate || '\",\"d\"]'))"


@review_query(f" select report as run_id, 'p' as pattern_id, 1::bigint as pattern_version, candidate as tool_key, 'd' as artifact_digest, {_UUID} as id from (select distinct report, candidate, {_HASHED} as h from ev)")
def w1_candidate_id(x: ReviewLens) -> DataFrame:
    rows = x.events.select(F.col("report").alias("run_id"), F.lit("p").alias("pattern_id"), F.lit(1).cast("long").alias("pattern_version"), F.col("candidate").alias("tool_key"), F.lit("d").alias("artifact_digest")).distinct()
    return rows.withColumn("id", review.candidate_id(_NAMESPACE, 1, "review"))


@review_query(" select report, seq + 1 as seq from ev where report in (select report from ev group by 1 having count(*) >= 5) and seq >= 5 union all select null, null where false")
def w2_event_sequence(x: ReviewLens) -> DataFrame:
    return review.sequence_gaps(x.events.withColumn("seq", F.when(F.col("seq") >= 5, F.col("seq") + 1).otherwise(F.col("seq"))))


@review_query(" select report, seq, case when candidate = 'c6' then 'unknown candidate' else 'broken chain' end as problem from chain where candidate = 'c6' or (event_id % 10 = 0 and from_disposition <> 'deferred')")
def w3_event_chain(x: ReviewLens) -> DataFrame:
    damaged = x.events.withColumn("from_disposition", F.when(F.col("event_id") % 10 == 0, "deferred").otherwise(F.col("from_disposition")))
    return review.chain_breaks(damaged, x.cases.filter("candidate <> 'c6'"))


@review_query(", cases as (select distinct report, 'c' || i as candidate from ev, range(8) t(i)) select c.report, c.candidate, coalesce(arg_max(disposition, seq), 'open') as disposition, count(seq) as events from cases c left join ev using (report, candidate) group by 1, 2")
def w4_current_disposition(x: ReviewLens) -> DataFrame:
    return review.current_dispositions(x.cases, x.events).select("report", "candidate", "disposition", "events")


@review_query(", m as (select report, candidate, arg_max(disposition, seq) as d from ev group by 1, 2), n as (select report, max(seq) as s, count(distinct candidate) as k from ev group by 1) select report, candidate, s + row_number() over (partition by report order by candidate) as seq, d as from_disposition from m join n using (report)")
def w5_append_events(x: ReviewLens) -> DataFrame:
    new = x.events.select("report", "candidate").distinct().withColumns({"disposition": F.lit("accepted"), "at": F.lit(1)})
    return review.append_events(x.events, new).select("report", "candidate", "seq", "from_disposition")


@review_query(" select field, count(*) as n from (select case event_id % 5 when 0 then 'note' when 1 then 'reviewer' when 2 then 'report' else 'recorded_at' end as field from ev) group by 1")
def w6_event_field_checks(x: ReviewLens) -> DataFrame:
    k = F.col("event_id") % 5
    rows = x.events.withColumns({
        "note": F.when(k == 0, "token: abc").otherwise("fine"), "reviewer": F.when(k == 1, "a\nb").otherwise("ann"), "report": F.when(k == 2, "x").otherwise(F.sha2("report", 256)),
        "recorded_at": F.when(k == 3, "2026-01-01T00:00:00").when(k == 4, "2026-02-30T00:00:00Z").otherwise("2026-01-01T00:00:00Z"),
    })
    return review.field_problems(rows).groupBy("field").agg(F.count("*").alias("n"))


@query(f"select agent as report, candidate, agent, candidate as tool_key, case when {_STRICT} is null then 'eligible' else 'rejected' end as decision, {_STRICT} as reason, 'review_policy' as action, false as automatic from scored where contains(candidate, '::') and pos % 2 = 0", of=AskedLens)
def b6_review_plan(x: AskedLens) -> DataFrame:
    cases = x.candidates.filter("contains(ref, '::')").select(F.col("agent").alias("report"), F.col("ref").alias("candidate"), F.col("ref").alias("tool_key"), "pos")
    events = cases.select("report", "candidate", F.lit(1).alias("seq"), F.when(F.col("pos") % 2 == 0, "accepted").otherwise("rejected").alias("disposition"), F.lit("ann").alias("reviewer"))
    agents = cases.select("report", F.col("report").alias("agent")).distinct()
    # What is accepted now was accepted by some event, so the graph is read for the candidates of such events.
    asked = events.filter("disposition = 'accepted'").select(F.col("candidate").alias("ref"))
    return review.review_plan(cases.drop("pos"), events, x.graph_for(asked), agents)


# ---- Snapshots, digests and intake --------------------------------------------------------------


@query("select 'tools' as name, count(*) as count, 2::bigint as generation from tools union all select 'can_call', count(*), 2 from can_call union all select 'data_access', count(*), 2 from data_access")
def s9_snapshot_publish(x: Lens) -> DataFrame:
    root = f"{snapshots.shared_dir(x.spark)}/graph-{uuid.uuid4().hex}"
    snapshots.publish(x.graph.with_tables(can_call=x.graph.can_call.limit(0)), root)
    snapshots.publish(x.graph, root)
    g = snapshots.read(x.spark, root)
    rows = g.tools.agg(F.count("*").alias("count")).select(F.lit("tools").alias("name"), "count").union(g.can_call.agg(F.count("*")).select(F.lit("can_call"), "count(1)")).union(g.data_access.agg(F.count("*")).select(F.lit("data_access"), "count(1)"))
    return snapshots.stamped(rows, snapshots.graph_state(x.spark, root)).select("name", "count", "generation")


def _policies_only(x: Lens, root: str) -> None:
    from palisade.sources.model import graph_of

    snapshots.publish(graph_of(x.spark, policies=x.graph.policies), root, digest="0" * 64)


@query("select 0::bigint as generation, true as no_digest, 0::bigint as policies from region limit 1", lens=False)
def s10_snapshot_reset(x: Lens) -> DataFrame:
    root = f"{snapshots.shared_dir(x.spark)}/graph-{uuid.uuid4().hex}"
    _policies_only(x, root)
    snapshots.reset(x.spark, root)
    left = snapshots.read(x.spark, root).policies.agg(F.count("*").alias("policies"))
    return snapshots.graph_state(x.spark, root).select("generation", F.col("governance_digest").isNull().alias("no_digest")).crossJoin(left)


@query("select 1::bigint as generation, repeat('0', 64) as governance_digest, (select count(*) from policies) as policies")
def s11_snapshot_state(x: Lens) -> DataFrame:
    root = f"{snapshots.shared_dir(x.spark)}/graph-{uuid.uuid4().hex}"
    _policies_only(x, root)
    n = snapshots.read(x.spark, root).policies.agg(F.count("*").alias("policies"))
    return snapshots.graph_state(x.spark, root).select("generation", "governance_digest").crossJoin(n)


@query("select id, effect, 1::bigint as generation, true as graph_state_verified from policies")
def s12_stamped_read(x: Lens) -> DataFrame:
    root = f"{snapshots.shared_dir(x.spark)}/graph-{uuid.uuid4().hex}"
    _policies_only(x, root)
    rows = snapshots.read(x.spark, root).policies.select("id", "effect")
    return snapshots.stamped(rows, snapshots.graph_state(x.spark, root)).select("id", "effect", "generation", "graph_state_verified")


@query(
    """, c as (select agent, tool_key, granted_by, evidence, '2026-01-0' || (seq % 9 + 1) || 'T10:00:00' || case seq % 5 when 0 then '' when 1 then '+02:00:30' when 2 then 'Z' else '-05:30' end as created_at from can_call)
  select agent, tool_key, case when created_at like '%0' and created_at not like '%30' then 'created_at has no offset' when created_at like '%+02:00:30' then 'created_at''s offset is not in whole minutes' end as problem,
    case when created_at not like '%:00' and created_at not like '%+02:00:30' then 'sha256:' || sha256('{"created_at":"' || created_at || '","kind":"grant","value":{"agent":"' || agent || '","by":"' || granted_by || '","evidence":' || coalesce('"' || evidence || '"', 'null') || ',"tool_key":"' || tool_key || '"}}' || chr(10)) end as digest,
    created_at not like '%:00' and created_at not like '%+02:00:30' as intact from c"""
)
def s13_artifact_sink(x: Lens) -> DataFrame:
    """Each grant as an artifact, written and read back; some times of creation have no offset or one with seconds."""
    grants = x.graph.can_call.select("agent", "tool_key", "granted_by", "prov.evidence")
    rows = grants.join(x.granted_at, ["agent", "tool_key"])
    made, refused = artifacts.artifacts(rows, "grant", F.struct("agent", F.col("granted_by").alias("by"), "evidence", "tool_key"), F.col("created_at"))
    path = f"{snapshots.shared_dir(x.spark)}/artifacts-{uuid.uuid4().hex}"
    artifacts.write_artifacts(made, path)
    got = artifacts.read_artifacts(x.spark, path)
    part = lambda name: F.get_json_object("body", f"$.value.{name}").alias(name)
    fine = got.select(part("agent"), part("tool_key"), F.lit(None).cast("string").alias("problem"), "digest", "intact")
    return fine.unionByName(refused.select("agent", "tool_key", "problem", F.lit(None).cast("string").alias("digest"), F.lit(False).alias("intact")))


#: Ways to damage what a server says of itself.
_FIRST = r'"tools":\[[{]"name":"[^"]*"'
_CRAWLS = [
    ("$", "", None),
    (r'("tools":\[[{]"name":")', "$1a::", "tools.0.name: must not hold '::'"),
    (_FIRST, '"tools":[{"name":null', "tools.0.name: must not be null"),
    (_FIRST, '"tools":[{"title":"x"', "tools.0.name: is missing"),
    (_FIRST, '"tools":[{"name":7', "tools.0.name: must be text"),
    (_FIRST, '"tools":[{"name":""', "tools.0.name: has a length out of bounds"),
    ('"tools":', '"tools":null,"old":', "tools: must not be null"),
    (r'"tools":\[', '"tools":["x",', "tools.0: must be an object"),
    (r'"tools":\[[{]', '"tools":[{"open_world_hint":"yes",', "tools.0.open_world_hint: must be true or false"),
    ('"transport":"stdio"', '"transport":"carrier"', "transport: must be one of the known values"),
    ('"server_name":"', '"server_name":"a::', "server_name: must not hold '::'"),
    ("[}]$", ',"resources":[{"uri":"store:x"},{"name":"y"}]}', "resources.1.uri: is missing"),
    ("[}]$", ',"resources":[{"uri":null}]}', "resources.0.uri: must not be null"),
    ("[}]$", "", "not JSON"),
    ("[}]$", ',"note":[1]}', None),
    ('"transport":"stdio",', "", None),
]


@query(
    f"""select server, tool_key, 'crawled from ' || server as evidence, 'stdio' as transport, null as problem from exposes where {_told(_CRAWLS, "cast(right(server, 9) as int)")} is null
  union all select distinct server, null, null, null, {_told(_CRAWLS, "cast(right(server, 9) as int)")} from exposes where {_told(_CRAWLS, "cast(right(server, 9) as int)")} is not null"""
)
def s1_crawl_intake(x: Lens) -> DataFrame:
    """What every server says of itself, damaged by the server's number: the edges of the crawls taken, and where the others are refused."""
    from palisade.sources import intake

    rows = x.graph.tools.join(x.graph.exposes.select(F.col("tool_key").alias("key")), "key", "left_semi").withColumn("endpoint", F.col("server"))
    docs = rows.groupBy("server").agg(F.sort_array(F.collect_list(F.struct("name", "description", "input_schema", "read_only_hint", "destructive_hint", "idempotent_hint"))).alias("tools"))
    value = F.to_json(F.struct(F.col("server").alias("server_name"), F.lit("2").alias("server_version"), F.lit("stdio").alias("transport"), F.col("server").alias("endpoint"), "tools"))
    got = intake.read_crawls(docs.select("server", _damaged(value, _CRAWLS, F.right("server", F.lit(9)).cast("int")).alias("value")))
    edges = got["exposes"].join(got["servers"].select(F.col("name").alias("server"), "transport"), "server").select("server", "tool_key", "prov.evidence", "transport", F.lit(None).cast("string").alias("problem"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    return edges.unionByName(got["refused"].select("server", none("tool_key"), none("evidence"), none("transport"), "problem"))


#: Ways to damage a copy of a manifest.
_MANIFESTS = [
    (r'("grants":\[[{])"agent":', '$1"who":', "grants.0.agent: is missing"),
    (r'"agents":\["[^"]*"\]', '"agents":[7]', "agents.0: must be text"),
    ("^[{]", '{"extra":1,', "has an unknown field"),
    ("^[{]", '{"policies":[{"id":"p","effect":"MAYBE"}],', "policies.0.effect: must be one of the known values"),
    ("^[{]", '{"governed_by":{"x":["p",7]},', "governed_by.0.1: must be an object"),
    ("^[{]", '{"governed_by":{"x":[{"policy":"p","note":1}]},', "governed_by.0.0: has an unknown field"),
    ("^[{]", '{"governed_by":{"x":[{"policy":"p","provenance":{"source":"rumour"}}]},', "governed_by.0.0.provenance.source: must be one of the known values"),
    ("^[{]", '{"governed_tools":{"a::b":"p"},', "governed_tools.0: must be a list"),
    ("^[{]", '{"data_access":null,', "data_access: must not be null"),
    (r'"grants":\[', '"grants":[{"agent":"a","tool":"t","granted_by":"token=abc"},', "grants.0.granted_by: must not hold a credential"),
]


@query(
    f"""select 'agent' as part, id as a, null as b, null as c, null as d from agents
  union all select 'policy', id, effect, scope, null from policies
  union all select 'grant', agent, tool_key, granted_by, evidence from can_call
  union all select 'access', tool_key, mode, uri, evidence from data_access
  union all select 'governed_resources', uri, policy, case when length(policy) % 2 = 0 then 'bare' else 'object' end, case when length(policy) % 2 = 1 then evidence end from governed_resource
  union all select 'governed_tools', tool_key, policy, case when length(policy) % 2 = 0 then 'bare' else 'object' end, null from governed_tool
  union all select 'exception', agent, tool_key, policy, coalesce(resource, '-') || ' ' || reason from exceptions
  union all select 'refused', id, {_told(_MANIFESTS, "c_custkey")}, null, null from agents where id in (select agent from can_call)"""
)
def s2_manifest_intake(x: Lens) -> DataFrame:
    """All six tables as JSON manifests, bindings of half the policies as bare ids, beside a damaged copy of each agent's manifest."""
    m, c = x.manifest, F.col
    evidence = F.struct("prov.source", "prov.confidence", "prov.evidence").alias("provenance")
    grants = m.grants.groupBy("agent").agg(F.collect_list(F.struct("agent", c("ref").alias("tool"), "granted_by", evidence)).alias("grants"))
    exc = m.exceptions.groupBy("agent").agg(F.collect_list(F.struct("agent", c("ref").alias("tool"), "policy", "resource", "reason")).alias("expected_exceptions"))
    agents = m.agents.select(c("id").alias("agent")).join(grants, "agent", "left").join(exc, "agent", "left")
    agents = agents.select("agent", F.to_json(F.struct(F.array("agent").alias("agents"), "grants", "expected_exceptions")).alias("value"), c("grants").isNotNull().alias("granted"))
    policies = m.policies.select(F.to_json(F.struct(F.array(F.struct("id", "effect", "scope", "description")).alias("policies"))).alias("value"))
    access = m.data_access.groupBy("ref").agg(F.collect_list(F.struct(c("ref").alias("tool"), "resource", "mode", evidence)).alias("data_access")).select(F.to_json(F.struct("data_access")).alias("value"))
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    item = F.when(F.length("policy") % 2 == 0, quoted(c("policy"))).otherwise(F.to_json(F.struct("policy", evidence)))
    bound = m.bindings.groupBy("field", "node").agg(F.array_join(F.collect_list(item), ",").alias("items"))
    bound = bound.select(F.concat(F.lit("{"), quoted(c("field")), F.lit(":{"), quoted(c("node")), F.lit(":["), "items", F.lit("]}}")).alias("value"))
    copies = agents.filter("granted").select("agent", _damaged(c("value"), _MANIFESTS, F.right("agent", F.lit(9)).cast("int")).alias("value"))
    none = F.lit(None).cast("string").alias("agent")
    got, refused = manifest.read_manifests(reduce(DataFrame.unionByName, [agents.select("agent", "value"), *[df.select(none, "value") for df in (policies, access, bound)], copies]))
    kind = F.when(F.length("policy") % 2 == 0, "bare").otherwise("object")
    listed = [
        got.agents.select(F.lit("agent"), "id", F.lit(None), F.lit(None), F.lit(None)),
        got.policies.select(F.lit("policy"), "id", "effect", "scope", F.lit(None)),
        got.grants.select(F.lit("grant"), "agent", "ref", "granted_by", "prov.evidence"),
        got.data_access.select(F.lit("access"), "ref", "mode", "resource", "prov.evidence"),
        got.bindings.select("field", "node", "policy", kind, "prov.evidence"),
        got.exceptions.select(F.lit("exception"), "agent", "ref", "policy", F.concat_ws(" ", F.coalesce("resource", F.lit("-")), "reason")),
        refused.select(F.lit("refused"), "agent", "problem", F.lit(None), F.lit(None)),
    ]
    return reduce(DataFrame.union, [df.toDF("part", "a", "b", "c", "d").select(*[c(n).cast("string").alias(n) for n in ("part", "a", "b", "c", "d")]) for df in listed])


#: Ways to damage a fleet file.
_FLEETS = [
    ("$", "", None),
    ('"cwd":"/srv"', '"cwd":" "', "servers.0.cwd: has another form"),
    ('"transport":"stdio"', '"transport":"sse"', "servers.0: has a cwd but no stdio transport"),
    ('"transport":"stdio",', "", None),
    ('"name":"', '"name":"a::', "servers.0.name: must not hold '::'"),
    ('"name":"[^"]*"', '"name":false', "servers.0.name: must be text"),
    ('"servers"', '"server"', "servers: is missing"),
    ("^.*$", '{"servers":null}', "servers: must not be null"),
    ("^.*$", '{"servers":{}}', "servers: must be a list"),
    ("^.*$", '{"servers":[7]}', "servers.0: must be an object"),
    ('"cwd"', '"user":"x","cwd"', "servers.0: has an unknown field"),
    ('"cwd"', '"env":{"A":1},"cwd"', "servers.0.env.0: must be text"),
    ('"cwd"', '"args":["a",null],"cwd"', "servers.0.args.1: must be text"),
    ("^.*$", "", "not JSON"),
]


@query(f"select s_suppkey as k, case when {_told(_FLEETS, 's_suppkey')} is null then s_name end as name, case when {_told(_FLEETS, 's_suppkey')} is null then 'stdio' end as transport, {_told(_FLEETS, 's_suppkey')} as problem from supplier", lens=False)
def s16_fleet_intake(x: Lens) -> DataFrame:
    from palisade.sources import intake

    spec = F.struct(F.col("s_name").alias("name"), F.lit("stdio").alias("transport"), F.lit("/srv/x").alias("command"), F.lit("/srv").alias("cwd"))
    specs, refused = intake.read_fleets(x.table("supplier").select("s_suppkey", _damaged(F.to_json(F.struct(F.array(spec).alias("servers"))), _FLEETS, F.col("s_suppkey")).alias("value")))
    named = specs.join(x.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")), "name")
    none = lambda name: F.lit(None).cast("string").alias(name)
    return named.select("k", "name", "transport", none("problem")).unionByName(refused.select(F.col("s_suppkey").alias("k"), none("name"), none("transport"), "problem"))


# ---- Text columns ----------------------------------------------------------------------------------

@query(f"select doc_id, coalesce({_SHAPED}, false) as credential from documents", lens=False)
def x1_credential_scan(x: Lens) -> DataFrame:
    return x.table("documents").select("doc_id", scrub.is_credential_shaped(F.col("text")).alias("credential"))


@query(f"select conv_id, turn, coalesce({_SHAPED} or regexp_matches(text, '(?s)://.*@'), false) as credential from conversations", lens=False)
def x2_identity_scan(x: Lens) -> DataFrame:
    return x.table("conversations").select("conv_id", "turn", scrub.is_credential_identity(F.col("text")).alias("credential"))


@query("select page_id, regexp_extract(url, '^([^?#]*)', 1) as shown from pages", lens=False)
def x3_display_resource(x: Lens) -> DataFrame:
    return x.table("pages").select("page_id", scrub.display_resource(F.col("url")).alias("shown"))


def _hidden_sql(text: str, names: tuple[str, ...]) -> str:
    """What SQL can say of a value: replace it by its form, one group of names at a time."""
    sign, ends = "[\\x27\\x22]?\\s*[:=]\\s*", "(?:[\\x27\\x22\\[{{](?:.|\\n)*|[^\\s,}}\\]]+)".replace("{{", "{").replace("}}", "}")
    return f"regexp_replace({text}, '(?i)({'|'.join(names)}){sign}{ends}', '\\1={scrub.HIDDEN}', 'g')"


_HEADER_SQL = f"regexp_replace(text, '(?i)authorization[\\x27\\x22]?\\s*[:=]\\s*\\S(?:.|\\n)*', 'Authorization={scrub.HIDDEN}')"
_BEARER_SQL = f"regexp_replace({_HEADER_SQL}, '(?i)\\b(bearer)\\s+[A-Za-z0-9._~+/=-]+', '\\1 {scrub.HIDDEN}', 'g')"
_REDACTED = reduce(_hidden_sql, scrub.ASSIGNED, _BEARER_SQL)


@query(f"select doc_id, {_REDACTED} as text from documents", lens=False)
def x4_redact_credentials(x: Lens) -> DataFrame:
    return x.table("documents").select("doc_id", scrub.redact_credentials(F.col("text")).alias("text"))


@query(f"select page_id, regexp_extract(url, '^([^?#]*)', 1) as url from pages where not coalesce(regexp_matches(url, '(?s)://.*@'), false)", lens=False)
def x5_scrub_evidence(x: Lens) -> DataFrame:
    clean, _ = scrub.scrub_rows(x.table("pages").select("page_id", "url", F.col("url").alias("name")), resources=("url",), identities=("name",))
    return clean.select("page_id", "url")


@query("select p_partkey, p_partkey % 3 <> 0 as clean from part", lens=False)
def x6_identity_shape(x: Lens) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.col("p_name"))
    return x.table("part").select("p_partkey", scrub.is_clean_identity(name).alias("clean"))
