"""Hand-traced scenarios of the governance operators."""

from palisade.operators import audit, crawl, deny, manifest, propose, resolve, scrub, selector
from palisade.plans import control
from palisade.sources import snapshots
from palisade.sources.model import duplicate_keys, graph_of
from pyspark.sql import functions as F

GOOD = {"source": "operator_asserted", "confidence": "high", "evidence": "ticket:1"}
BARE = {"source": "operator_asserted", "confidence": "high", "evidence": " \t"}


def small(spark):
    tool = lambda k, **x: {"key": k, "name": k.split("::")[1], "server": k.split("::")[0], **x}
    row = lambda p=GOOD, **x: x | {"prov": (p["source"], p["confidence"], p["evidence"])}
    return graph_of(
        spark,
        agents=[{"id": "planner"}, {"id": "bot"}],
        servers=[{"name": "s"}],
        tools=[tool("s::read", read_only_hint=True), tool("s::write", destructive_hint=True), tool("s::plain"), tool("z::read")],
        resources=[{"uri": "file:///a"}, {"uri": "file:///b"}],
        policies=[{"id": "no", "effect": "DENY"}, {"id": "ok", "effect": "ALLOW"}, {"id": "idle", "effect": "DENY"}],
        exposes=[row(server="s", tool_key="s::read"), row(server="s", tool_key="s::plain")],
        can_call=[row(agent="planner", tool_key="s::read", granted_by="me"), row(agent="planner", tool_key="s::plain"), row(agent="bot", tool_key="s::read")],
        data_access=[row(tool_key="s::read", mode="READS", uri="file:///a"), row(tool_key="s::read", mode="WRITES", uri="file:///b"), row(BARE, tool_key="s::write", mode="WRITES", uri="file:///b")],
        governed_resource=[row(uri="file:///a", policy="no")],
        exceptions=[{"agent": "planner", "tool_key": "s::read", "policy": "no", "resource": None, "reason": "wild"}, {"agent": "planner", "tool_key": "s::read", "policy": "no", "resource": "file:///a", "reason": None}],
    )


def test_specific_exception_wins_even_without_a_reason(spark):
    rows = {r.agent: r for r in deny.classified_paths(small(spark)).collect()}
    assert rows["planner"].classification == "authorized_but_governed" and rows["planner"].exception_reason is None
    assert rows["bot"].classification == "violation"
    assert rows["bot"].path == "(read) -READS-> (file:///a) -GOVERNED_BY-> (no:DENY)"


def test_check_access_keeps_unknowns_apart(spark):
    asked = spark.createDataFrame([("planner", "s::read"), ("bot", "s::plain"), ("planner", "read"), ("planner", "gone"), ("nobody", "s::read"), ("planner", "s::plain")], "agent string, ref string")
    got = {(r.agent, r.ref): r for r in selector.check_access(small(spark), asked).collect()}
    assert [got[k].verdict for k in (("planner", "s::read"), ("bot", "s::plain"), ("planner", "read"), ("planner", "gone"), ("nobody", "s::read"), ("planner", "s::plain"))] == ["DENY", "NOT_GRANTED", "AMBIGUOUS_TOOL", "TOOL_NOT_FOUND", "AGENT_NOT_FOUND", "ALLOW"]
    assert got["planner", "s::read"].all_authorized is True and got["nobody", "s::read"].found is None


def test_audits(spark):
    g = small(spark)
    assert [r.tool_key for r in audit.unmapped_tools(g).collect()] == ["s::plain"]
    assert {r.tool_key for r in audit.drifted_tools(g).collect()} == {"s::write"}
    assert {r.policy for r in audit.orphan_policies(g).collect()} == {"ok", "idle"}
    assert [(r.src, r.dst) for r in audit.unbacked_edges(g).collect()] == [("s::write", "file:///b")]
    assert [r.tool_key for r in audit.annotation_contradictions(g).collect()] == ["s::read"]
    assert {r.status for r in audit.audit_report(g).collect()} == {"fail"}
    assert duplicate_keys(g).count() == 0


def test_what_audits_list(spark):
    g = small(spark)
    plain = audit.unmapped_tools(g).first()
    assert plain.granted_to == ["planner"] and audit.unmapped_tools(g, shown="counts").first().granted_to_count == 1
    every = {r.tool_key: r.granted_to for r in audit.unmapped_tools(g, only_granted=False).collect()}
    assert every == {"s::plain": ["planner"], "z::read": []}
    drifted = audit.drifted_tools(g).first()
    assert (drifted.granted_to, drifted.data_access) == ([], ["WRITES file:///b"])
    counted = audit.drifted_tools(g, shown="counts").first()
    assert (counted.granted_to_count, counted.data_access_count) == (0, 1)
    assert audit.orphan_policies(g, shown=None).columns == ["policy", "effect", "scope"]
    assert sorted((r.tool_key, r["item"]) for r in audit.callers(g).collect()) == [("s::plain", "planner"), ("s::read", "bot"), ("s::read", "planner")]
    assert [(r.policy, r["item"]) for r in audit.governed(g)[0].collect()] == [("no", "file:///a")]


def test_canonical_uris(spark):
    cases = {"HTTP://Ex.com:80/a/../b?q": "http://ex.com/b?q", "https://EX.com": "https://ex.com/", "file:///A/b": "file:///A/b", "s::tool": "s::tool", "https://h:8443/x/./y/": "https://h:8443/x/y/", "not a uri": "not a uri"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", resolve.canonical_uri(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == cases


def test_credentials(spark):
    cases = {"bolt://u:p@h": True, "token: rotated weekly": True, "get_token:v2": False, "token::refresh": False, "Bearer abc": True, "%74oken%3Dabc": True, "plain text": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scrub.is_credential_shaped(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == cases
    shown = spark.createDataFrame([("https://u:p@h/x?y#z",), ("neo4j://u:p/w@h",), ("plain",)], "t string").select(scrub.display_resource(F.col("t"))).collect()
    assert [r[0] for r in shown] == ["https://h/x", "neo4j://<redacted-uri>", "plain"]


def test_instants(spark):
    cases = {"2026-01-01T00:00:00Z": True, "2026-01-01": False, "2026-01-01T24:00:00Z": False, "2026-01-01T00:00:00-00:00": False, "2026-02-30T00:00:00Z": False, "2026-01-01T10:00+02:00": True}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", propose.instant(F.col("t")).isNotNull().alias("b")).collect()
    assert {r.t: r.b for r in rows} == cases


def test_retired_servers_keep_governed_tools(spark):
    g = crawl.retire_servers(small(spark), spark.createDataFrame([("other",)], "name string"))
    tools = {r.key: r for r in g.tools.collect()}
    assert set(tools) == {"s::read", "s::write", "s::plain", "z::read"} and tools["s::read"].read_only_hint is None
    assert g.exposes.count() == 0 and g.servers.count() == 0


def test_applying_its_own_manifest_changes_nothing_authored(spark, sf):
    from palisade.operators import diff
    from palisade.sources.lens import Lens

    x = Lens(spark, sf)
    new = manifest.apply_manifest(x.manifest, x.graph)
    assert diff.grants(x.graph, new).count() == 0 and diff.exceptions(x.graph, new).count() == 0 and diff.data_access(x.graph, new).count() == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert snapshots.graph_state(spark, root).first().generation == 0
    snapshots.publish(small(spark), root, digest="a" * 64)
    snapshots.publish(small(spark), root)
    assert tuple(snapshots.graph_state(spark, root).first())[1:] == (2, "a" * 64) and snapshots.read(spark, root).tools.count() == 4
    snapshots.reset(spark, root)
    assert tuple(snapshots.graph_state(spark, root).first())[1:] == (0, None) and snapshots.read(spark, root).tools.count() == 0


def plan(spark, edges, nodes):
    rows = [("r", n, n if n in ("start", "end") else "step", False, None, None, i) for i, n in enumerate(nodes)]
    n = spark.createDataFrame(rows, "run_id string, node string, kind string, agent_call boolean, invocations long, parallelism long, pos int")
    e = spark.createDataFrame([("r", a, b, "next", "code", None, i) for i, (a, b) in enumerate(edges)], "run_id string, source string, target string, kind string, decided_by string, fan_out long, pos int")
    return control.Plans(spark.createDataFrame([("r", 1, 1)], "run_id string, max_calls long, max_parallel long"), spark.createDataFrame([], "run_id string, principal string, tool string"), n, e)


def test_plan_lints(spark):
    p = plan(spark, [("start", "a"), ("a", "b"), ("b", "a"), ("b", "end"), ("c", "end"), ("a", "lost")], ["start", "a", "b", "c", "d", "end"])
    got = {(r.code, r.subject) for r in control.lint(p).collect()}
    assert got == {("unknown_node", "lost"), ("unreachable", "c"), ("unreachable", "d"), ("no_terminal_path", "d"), ("cycle", "a"), ("cycle", "b"), ("cycle", "end")}


def test_witness_paths(spark):
    nodes = [f"n{i:03}" for i in range(40)]
    p = plan(spark, list(zip(nodes, nodes[1:], strict=False)), nodes)
    pairs = spark.createDataFrame([("r", "n000", "n039"), ("r", "n000", "n002")], "run_id string, reader string, writer string")
    got = {r.writer: r.path for r in control.witness_paths(p, pairs).collect()}
    assert got["n002"] == nodes[:3] and len(got["n039"]) == 32 and got["n039"][16] == "... (9 intermediate nodes) ..."


def test_candidate_ids_are_uuid5(spark):
    import json
    import uuid

    from palisade.operators import review

    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    rows = [("r", "p", 1, "s::é\"x", "d"), ("r2", "p", 12, "s::y", "e")]
    d = spark.createDataFrame(rows, "run_id string, pattern_id string, pattern_version long, tool_key string, artifact_digest string")
    want = [str(uuid.uuid5(uuid.UUID(space), json.dumps([1, "k", *r], ensure_ascii=False, separators=(",", ":")))) for r in rows]
    assert [r[0] for r in d.select(review.candidate_id(space, 1, "k")).collect()] == want
