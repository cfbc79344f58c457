"""Plans of the largest size, ranking over many tasks, digests and artifacts."""

import hashlib
import json
import random
import time

import pytest
from palisade.operators import manifest, propose
from palisade.plans import control
from palisade.sources import artifacts
from pyspark.sql import functions as F
from test_governance import plan


def test_a_chain_of_the_most_nodes(spark):
    n = control.MOST_NODES
    nodes = ["start", *(f"n{i:05}" for i in range(n - 2)), "end"]
    p = plan(spark, list(zip(nodes, nodes[1:], strict=False)), nodes)
    began = time.time()
    assert control.unreachable(p).count() == control.no_terminal_path(p).count() == control.cycles(p).count() == 0
    loop = plan(spark, [*zip(nodes, nodes[1:], strict=False), (nodes[-2], nodes[1])], nodes)
    assert control.cycles(loop).count() == n - 1
    pairs = spark.createDataFrame([("r", "start", "end")], "run_id string, reader string, writer string")
    path = control.witness_paths(p, pairs).first().path
    assert len(path) == control.MOST_PATH and path[16] == f"... ({n - 31} intermediate nodes) ..."
    assert time.time() - began < 60


def written(k: int) -> str:
    nodes = [{"id": f"n{i}", "kind": "router", "principals": ["p"], "agent_call": False} for i in range(k)]
    limits = {"maximum_agent_calls": 1, "maximum_parallelism": 1, "maximum_cycles": 0}
    return json.dumps({"schema_version": 1, "kind": "any.control-plan", "run_id": str(k), "producer": {"name": "x", "version": "1"}, "principals": [{"id": "p", "candidate_tools": ["a::b"]}], "nodes": nodes, "edges": [], "limits": limits})


def test_plans_beyond_the_bounds_are_refused(spark):
    rows = spark.createDataFrame([(written(k), k) for k in (3, control.MOST_NODES, control.MOST_NODES + 1)] + [("x" * (control.MOST_BYTES + 1), 0), (None, -1)], "value string, at long")
    got, refused = control.read_plans(rows)
    assert {r.run_id for r in got.plans.collect()} == {"3", str(control.MOST_NODES)} and got.nodes.count() == 3 + control.MOST_NODES
    assert {r["at"]: r.problem for r in refused.collect()} == {control.MOST_NODES + 1: "nodes: has too many items", 0: "too long", -1: "not JSON"}


def test_a_dense_plan_of_the_largest_size(spark):
    rng = random.Random(5)
    names = [f"n{i:04}" for i in range(control.MOST_NODES)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(control.MOST_EDGES)]
    p = plan(spark, edges, names)
    some = lambda: spark.createDataFrame([("r", v) for v in rng.sample(names, 1000)], "run_id string, node string")
    readers, writers = some(), some()
    began = time.time()
    got = control.flows(p.edges, readers, writers).groupBy("reader").count().collect()
    assert time.time() - began < 60 and sum(r["count"] for r in got) > 500_000


@pytest.mark.parametrize("seed", range(5))
def test_distances_and_paths_against_plain_search(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    after: dict = {}
    for _ in range(rng.choice([10, 30, 60])):
        after.setdefault(rng.choice(names), set()).add(rng.choice(names))
    targets = sorted(rng.sample(names, 8))
    known = control.Distances(after, targets)
    for s in known.names:
        best, layer = {s: [s]}, [[s]]
        while layer:
            layer = sorted([*path, v] for path in layer for v in after.get(path[-1], ()) if v not in best)
            for path in layer:
                best.setdefault(path[-1], path)
            layer = [p for p in layer if best[p[-1]] is p]
        for t in targets:
            far = known.far[known.number[s], known.targets[t]]
            assert (far == control.FAR) == (t not in best) and (t not in best or known.path(s, t) == best[t])


def test_ranking_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["addition"] * 8 + ["conflict", "dropped"]), f"a{rng.randrange(40)}", f"t{i}", rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "bucket string, agent string, ref string, would_block_calls long").repartition(7)
    got = {(r.bucket, r["rank"]): (r.agent, r.ref) for r in propose.ranked(df).collect()}
    for b in ("addition", "conflict", "dropped"):
        mine = sorted((0 if b == "conflict" else -w, a, t) for k, a, t, w in rows if k == b)
        assert [got[b, i + 1] for i in range(len(mine))] == [m[1:] for m in mine]
    assert len(got) == len(rows) and propose.ranked(df.limit(0)).count() == 0


def test_sorted_digest(spark):
    rows = [hashlib.sha256(str(i % 700).encode()).hexdigest() for i in range(1000)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    six = {}
    for h in sorted(rows):
        six.setdefault(h[:6], []).append(h)
    three = {}
    for p in sorted(six):
        three.setdefault(p[:3], []).append(sha("".join(six[p])))
    want = sha("".join(sha("".join(three[q])) for q in sorted(three)))
    assert tuple(manifest.sorted_digest(spark.createDataFrame([(h,) for h in rows], "h string")).first()) == (want, 1000)
    assert manifest.sorted_digest(spark.createDataFrame([], "h string")).first().n == 0


@pytest.mark.parametrize("at, problem", [("2026-01-01T00:00:00Z", None), ("2026-01-01T00:00:00.5+05:30", None), ("2026-01-01T00:00:00", "no offset"), ("2026-01-01T00:00:00+05:30:01", "whole minutes"), ("today", "time stamp"), (None, "time stamp")])
def test_artifacts(spark, tmp_path, at, problem):
    rows = spark.createDataFrame([("é\"x", None, at)], "b string, a long, at string")
    made, refused = artifacts.artifacts(rows, "k", F.struct("b", F.struct("a", "b").alias("deep")), F.col("at"))
    if problem:
        assert problem in refused.first().problem and made.count() == 0
        return
    artifacts.write_artifacts(made, str(tmp_path / "x"))
    got = artifacts.read_artifacts(spark, str(tmp_path / "x")).first()
    body = json.dumps({"created_at": at, "kind": "k", "value": {"b": 'é"x', "deep": {"a": None, "b": 'é"x'}}}, ensure_ascii=False, separators=(",", ":"), sort_keys=True) + "\n"
    assert got.body == body and got.digest == "sha256:" + hashlib.sha256(body.encode()).hexdigest() and got.intact
