"""Steps that many queries share derive their tables once and deal rows no more often than they are joined."""

import pytest
from palisade.operators import deny, manifest, selector
from palisade.plans.control import Plans, principal_decisions
from palisade.sources.lens import StoredLens


@pytest.fixture(scope="module")
def x(spark, sf):
    return StoredLens(spark, sf)


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_tables_are_read_from_what_was_written(x):
    for name in ("tools", "exposes", "governed_resource", "governed_tool", "provides", "resources", "servers"):
        text = plan(getattr(x.graph, name))
        assert "Aggregate" not in text and "Join" not in text, name


def test_tools_and_servers_follow_from_their_keys(x):
    rows = x.tool_rows.collect()
    assert rows and all(r.tool_key == f"{r.server}::{r.tool}" for r in rows)


def test_a_changed_graph_is_written_once(x):
    after = manifest.apply_manifest(x.manifest, x.graph)
    assert after.can_call is after.can_call
    assert "Join" not in plan(after.can_call)


def test_bindings_are_resolved_without_the_grants(x):
    grants = x.manifest.grants.filter("ref not like '%marked_grant%'")
    text = plan(manifest.resolve_manifest(x.manifest.with_tables(grants=grants), x.graph.tools).bindings, "logical")
    assert "marked_grant" not in text


def test_warnings_are_found_once(x):
    none = x.manifest.with_tables(exceptions=x.manifest.exceptions.limit(0))
    assert "Join" not in plan(manifest.ingest(none, x.graph)[1])


def test_no_rows_are_dealt_by_a_mark(x):
    text = plan(selector.rank_features(x.graph, x.candidates), "executedPlan")
    assert not [line for line in text.splitlines() if "hashpartitioning" in line and ", true, " in line]


def test_candidates_keep_their_plan(spark, x):
    asked = x.candidates.selectExpr("agent as run_id", "agent as principal", "ref as tool")
    asked = asked.unionByName(asked).unionByName(spark.sql("select 'r' as run_id, 'ghost' as principal, 'a::b' as tool"))
    got = principal_decisions(Plans(None, asked, None, None), x.graph)
    assert "Window" not in plan(got)
    single = {(r.agent, r.candidate): r.reason for r in selector.eligible_tools(x.graph, x.candidates).collect()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 2 * x.candidates.count() + 1 and ("r", "ghost", "a::b", None, "AGENT_NOT_FOUND") in rows
    assert all(single[a, ref] == reason for run, a, ref, _, reason in rows if run != "r")


def test_evidence_equals_matched_exceptions(spark, x):
    g = x.graph
    pairs = g.can_call.select("agent", "tool_key")
    some = deny.deny_paths(g).filter("via = 'resource'").limit(1).cache()
    whole = some.selectExpr("agent", "tool_key", "cast(null as string) as resource", "policy", "'whole' as reason")
    own = some.selectExpr("agent", "tool_key", "resource", "policy", "cast(null as string) as reason")
    odd = g.with_tables(exceptions=whole.unionByName(own).unionByName(whole))
    lists = deny.deny_evidence(odd, pairs).selectExpr("agent", "tool_key", "explode(deny_paths) as p").selectExpr("agent", "tool_key", "p.mode", "p.resource", "p.policy", "p.classification", "p.exception_reason")
    plain = deny.described(deny.match_exceptions(deny.deny_paths(odd), odd.exceptions)).select(*lists.columns)
    assert lists.exceptAll(plain).isEmpty() and plain.exceptAll(lists).isEmpty()
    assert not lists.filter("classification <> 'violation'").isEmpty()


def test_decisions_without_evidence_carry_no_paths(x):
    graph, asked = x.graph, x.candidates
    told = selector.eligible_tools(graph, asked).drop("deny_paths", "paths")
    slim = selector.eligible_tools(graph, asked, evidence=False)
    rows = lambda df: sorted(map(str, df.collect()))
    assert slim.columns == told.columns and rows(slim) == rows(told)
    assert {"violation", "authorized_but_governed"} <= {r.classification for r in slim.collect()}
    decided = principal_decisions(Plans(None, asked.selectExpr("agent as run_id", "agent as principal", "ref as tool"), None, None), graph)
    assert "GOVERNED_BY" not in plan(decided)
