"""Decisions of control plans against a plain check of each plan."""

from collections import Counter, defaultdict

import __spark_entry__ as entry
from palisade import late_queries
from palisade.plans import control


def faulty(limits, nodes, edges):
    """Whether a plan has any structural fault."""
    ids = Counter(n.node for n in nodes)
    starts, ends = ([n.node for n in nodes if n.kind == k] for k in ("start", "end"))
    after, before = defaultdict(set), defaultdict(set)
    for e in edges:
        after[e.source].add(e.target)
        before[e.target].add(e.source)

    def reached(seed, steps):
        seen, todo = {seed}, [seed]
        while todo:
            new = steps[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    return (
        len(starts) != 1
        or len(ends) != 1
        or max(ids.values()) > 1
        or any(x not in ids for e in edges for x in (e.source, e.target))
        or not set(ids) <= reached(starts[0], after)
        or not set(ids) <= reached(ends[0], before)
        or any(n in reached(m, after) for n in ids for m in list(after[n]))
        or any(e.kind == "fanout" and e.decided_by == "model" and e.fan_out is None for e in edges)
        or sum(n.invocations or 0 for n in nodes) > limits.max_calls
        or max(n.parallelism or 0 for n in nodes) > limits.max_parallel
    )


def test_every_finding_warns(spark, sf):
    x = late_queries.PlanLens(spark, sf)
    nodes, edges = defaultdict(list), defaultdict(list)
    for rows, to in ((x.plans.nodes, nodes), (x.plans.edges, edges)):
        for r in rows.collect():
            to[r.run_id].append(r)
    bad = {p.run_id for p in x.plans.plans.collect() if faulty(p, nodes[p.run_id], edges[p.run_id])}
    rejected = {r.run_id for r in control.principal_decisions(x.plans, x.graph).filter("reason is not null").select("run_id").distinct().collect()}
    flows = {r.run_id for r in late_queries._flows(x).select("run_id").distinct().collect()}
    got = {r.run_id: r.decision for r in entry.queries()["c15_plan_decision"](spark, sf).collect()}
    assert got == {k: "advisory_warn" if k in bad | rejected | flows else "advisory_allow" for k in nodes}
    calls = {r.run_id for r in control.call_bound(x.plans).select("run_id").collect()}
    print("plans", len(got), "allow before", len(got.keys() - rejected - flows - calls), "allow now", sum(d == "advisory_allow" for d in got.values()), "with findings", len(bad))
    assert bad - rejected - flows - calls
