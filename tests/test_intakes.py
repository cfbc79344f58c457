"""Typed intake: what each document is refused for, and that nothing else goes with it."""

import json

import pytest
from palisade.operators import crawl, decisions, manifest, propose
from palisade.sources import intake, schema


def lines(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "at long, value string")


def told(refused):
    return {r["at"]: r.problem for r in refused.collect()}


def test_rules(spark):
    rule = schema.Fields({"n": schema.Whole(1), "x": schema.Number(0, 1), "t": schema.Text(1, 3, values=("a", "bb")), "l": schema.Items(schema.Flag(), 0, 2), "m": schema.Mapping(schema.Whole())}, required=("n",), nullable=("t",))
    docs = [{"n": 1}, {"n": 1.0}, {"n": 1.5}, {"n": True}, {"n": None}, {}, [], 7, "{", None, {"n": 0}, {"n": 1, "x": 2}, {"n": 1, "t": None}, {"n": 1, "t": "c"}, {"n": 1, "l": [True, 1]}, {"n": 1, "l": [True] * 3}, {"n": 1, "m": {"a": 1, "b": "x"}}, {"n": 1, "further": [None]}, '{"n": 1, "n": 1}', '{"n": 1e2}', '{"n": Infinity}']
    got = {r["at"]: r.problem for r in schema.checked(lines(spark, docs), rule).collect()}
    want = {2: "n: must be an integer", 3: "n: must be an integer", 4: "n: must not be null", 5: "n: is missing", 6: "must be an object", 7: "must be an object", 8: "not JSON", 9: "not JSON", 10: "n: must be at least 1", 11: "x: is out of bounds", 13: "t: must be one of the known values", 14: "l.1: must be true or false", 15: "l: has too many items", 16: "m.1: must be an integer", 18: "not JSON", 20: "not JSON"}
    assert {k: v for k, v in got.items() if v} == want


def test_crawl_is_refused_whole(spark):
    fine = {"server_name": "s", "tools": [{"name": "a", "input_schema": {"type": "object"}}, {"name": "b", "read_only_hint": True}], "resources": [{"uri": "HTTP://H:80"}]}
    bad = [{"name": "x::y"}, {"name": None}, {"name": "ok"}]
    got = intake.read_crawls(lines(spark, [fine, {"server_name": "t", "tools": bad}, {"server_name": "u", "tools": bad[2:], "resources": [{"name": "no uri"}]}, {"server_name": "password=x"}]))
    assert sorted(r.key for r in got["tools"].collect()) == ["s::a", "s::b"] and [r.uri for r in got["provides"].collect()] == ["http://h/"]
    assert told(got["refused"]) == {1: "tools.0.name: must not hold '::'", 2: "resources.0.uri: is missing", 3: "server_name: must not hold a credential"}
    assert json.loads(got["tools"].filter("name = 'a'").first().input_schema) == {"type": "object"}
    assert got["servers"].count() + got["refused"].count() == 4


def test_shared_resource_takes_the_last_crawl(spark):
    docs = [{"server_name": "first", "resources": [{"uri": "store:own"}, {"uri": "store:x", "name": "from first"}]}, {"server_name": "last", "resources": [{"uri": "store:x", "name": "from last"}]}]
    rows = lines(spark, docs).withColumnRenamed("at", "crawl")
    listed = intake.read_crawls(rows)["resources"]
    none = spark.createDataFrame([], "uri string, name string, mime_type string, description string")
    assert {r.uri: r.name for r in crawl.upsert_resources(none, listed).collect()} == {"store:own": None, "store:x": "from last"}


def test_manifest_unions(spark):
    docs = [
        {"agents": ["a"], "governed_by": {"store:x": ["p", {"policy": "q", "provenance": {"evidence": "e"}}]}, "grants": [{"agent": "a", "tool": "s::t"}]},
        {"agents": [{"id": "a"}]}, {"governed_by": {"store:x": [7]}}, {"governed_tools": {"token=abc": ["p"]}}, {"grants": None}, {"note": 1}, {},
    ]
    got, refused = manifest.read_manifests(lines(spark, docs))
    assert sorted((r.seq, r.policy, r.prov.source, r.prov.evidence) for r in got.bindings.collect()) == [(0, "p", "operator_asserted", None), (1, "q", "operator_asserted", "e")]
    assert got.agents.count() == got.grants.count() == 1
    assert told(refused) == {1: "agents.0: must be text", 2: "governed_by.0.0: must be an object", 3: "governed_tools.0: has a name that must not hold a credential", 4: "grants: must not be null", 5: "has an unknown field"}


def test_exports_from_files(spark, tmp_path):
    row = {"agent": "a", "tool_key": "s::t", "decision": "rejected", "calls": 3, "would_block_calls": 2, "reject_reasons": ["not_granted"]}
    text = lambda *rows: "\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows)
    files = {
        "fine": text("", {"envelope": {"profile": "strict"}}, row, row | {"agent": "b", "calls": 3.0}),
        "twice": text(row, row | {"agent": "b"}, row),
        "late": text(row, {"envelope": {}}),
        "legacy": text({k: v for k, v in row.items() if k != "reject_reasons"} | {"reject_reason": "NOT_GRANTED", "tool_key": None, "candidate": "t"}),
        "uncounted": text({k: v for k, v in row.items() if k != "calls"}),
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    got = propose.read_exports(propose.export_files(spark, str(tmp_path)))
    name = lambda r: r.export.rsplit("/", 1)[1]
    assert {name(r): (r.line, r.problem) for r in got.refused.collect()} == {"twice": (3, "repeats an agent and ref"), "late": (2, "agent: is missing"), "uncounted": (1, "blocks calls without counting any")}
    assert sorted((name(r), r.agent, r.ref, r.calls, r.reasons, r.reasons_complete) for r in got.rows.collect()) == [("fine", "a", "s::t", 3, ["NOT_GRANTED"], True), ("fine", "b", "s::t", 3, ["NOT_GRANTED"], True), ("legacy", "a", "t", 3, ["NOT_GRANTED"], False)]
    assert [(name(r), r.profile) for r in got.envelopes.collect()] == [("fine", "strict")]


@pytest.mark.parametrize(
    "change, problem",
    [
        ({}, None),
        ({"after": {"decision": "eligible", "reason": "DRIFTED"}}, "rows.0.after: is eligible with a reason"),
        ({"after": {"decision": "rejected", "reason": None}}, "rows.0.after: is rejected without a reason of its own"),
        ({"after": {"decision": "rejected", "reason": "TOOL_NOT_FOUND"}}, "rows.0.after: is rejected without a reason of its own"),
        ({"after": {"tool_key": None}}, "rows.0.after: is decided without agent or key"),
        ({"after": {"tool_key": "s"}}, "rows.0.after.tool_key: has another form"),
        ({"before": {"decision": "unresolved", "reason": "AGENT_NOT_FOUND", "tool_key": None}}, "rows.0.before: contradicts whether the agent was found"),
        ({"before": {"decision": "unresolved", "reason": "TOOL_NOT_FOUND"}}, "rows.0.before: is unresolved but has a key"),
        ({"change": "unchanged"}, "rows.0: has a change that its decisions don't show"),
        ({"details_changed": False}, "rows.0: is wrong about changed details"),
        ({"candidate": " t"}, "rows.0.candidate: has another form"),
    ],
)
def test_impacts(spark, change, problem):
    side = {"decision": "rejected", "reason": "NOT_GRANTED", "tool_key": "s::t", "agent_found": True, "risk_score": 0.2, "evidence": [{"any": 1}], "is_drifted": False, "is_unmapped": None, "has_unbacked_edges": None}
    row = {"candidate": "t", "before": side, "after": side | {"decision": "eligible", "reason": None}, "change": "newly_eligible", "details_changed": True}
    for k, v in change.items():
        row[k] = row[k] | v if isinstance(v, dict) else v
    sha = "a" * 64
    doc = {"schema_version": 1, "kind": "any.policy-impact", "mode": "advisory", "created_at": "2026-01-01T00:00:00+02:00", "graph_state": {"instance_id": "i", "generation": 0}, "baseline_governance_digest": sha, "proposed_governance_digest": sha, "catalog_digest": sha}
    doc |= {"agent": "a", "profile": "strict", "candidates": ["t"], "complete": True, "rows": [row], "regression_ready": True, "notices": []}
    reports, rows, refused = decisions.read_impacts(lines(spark, [doc]))
    assert told(refused) == ({0: problem} if problem else {})
    if not problem:
        assert [(r.pos, r.ref, r.change) for r in rows.collect()] == [(0, "t", "newly_eligible")] and len(reports.first().digest) == 64


def test_a_day_of_many_events_is_told_in_documents_within_the_limit(spark, sf, monkeypatch):
    from palisade import late_queries, queries
    from palisade.operators import review

    rows = lambda: sorted(map(str, queries.QUERIES["s6_annotation_intake"](spark, sf).collect()))
    whole = rows()
    monkeypatch.setattr(review, "MOST_BYTES", 8_000)
    monkeypatch.setattr(late_queries, "MOST_TOLD", 10, raising=False)
    assert rows() == whole and not any("too long" in r for r in whole)
