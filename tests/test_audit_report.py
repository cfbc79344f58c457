"""The audit report counts what the finding tables hold, without a join for each of them."""

from palisade.operators import audit
from palisade.sources.lens import StoredLens
from palisade.sources.model import graph_of


def counted(graph, **more):
    return {r.finding: r["count"] for r in audit.audit_report(graph, **more).collect()}


def test_counts_are_those_of_the_findings(spark):
    said, bare = ("operator_asserted", "high", "e"), ("operator_asserted", "high", " ")
    rows = dict(
        tools=[{"key": k, "name": k, "server": "s", "read_only_hint": k in ("a", "b"), "destructive_hint": k in ("c", "d", "f") or None} for k in "abcdef"] + [{"key": None, "name": "x", "server": "s", "read_only_hint": True, "destructive_hint": True}],
        agents=[{"id": "p"}],
        policies=[{"id": i, "effect": e} for i, e in (("deny", "DENY"), ("allow", "ALLOW"), ("idle", "DENY"))],
        exposes=[{"server": "s", "tool_key": k, "prov": said} for k in ("a", "a", "c", "d")],
        can_call=[{"agent": "p", "tool_key": k, "prov": bare} for k in ("a", "b", "e", None)],
        data_access=[{"tool_key": k, "mode": m, "uri": u, "prov": v} for k, m, u, v in (("a", "WRITES", "u", said), ("a", "WRITES", "v", bare), ("b", "READS", "u", bare), ("c", "READS", "u", said), ("d", "WRITES", None, said), (None, "WRITES", "u", bare))],
        governed_resource=[{"uri": "u", "policy": p, "prov": v} for p, v in (("deny", said), ("allow", bare))],
        governed_tool=[{"tool_key": "f", "policy": "idle", "prov": bare}],
        exceptions=[{"agent": "p", "tool_key": "b", "policy": "deny"}],
    )
    graph = graph_of(spark, **rows)
    for more in ({}, {"include_grants": True}):
        assert counted(graph, **more) == {name: df.count() for name, df in audit.findings(graph, shown=None, **more).items()}
    assert min(counted(graph).values()) > 0
    assert set(counted(graph_of(spark)).values()) == {0}


def test_the_plan_has_few_joins(spark, sf):
    x = StoredLens(spark, sf)
    text = audit.audit_report(x.graph)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in text.splitlines()) <= 16
    assert counted(x.graph) == {name: df.count() for name, df in audit.findings(x.graph, shown=None).items()}
