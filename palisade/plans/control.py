"""Control plans, many at once: structural lints, exposures and decisions.

A plan is four tables keyed by run_id: plans(run_id, max_calls, max_parallel),
principals(run_id, principal, tool), nodes(run_id, node, kind, agent_call,
invocations, parallelism, pos), edges(run_id, source, target, kind,
decided_by, fan_out, pos).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from palisade.operators import selector
from palisade.operators.scrub import is_credential_identity, is_credential_shaped
from palisade.sources.model import Graph
from palisade.sources.schema import Fields, Flag, Items, Text, Whole, as_list, checked, repeats, texts
from palisade.sources.snapshots import cut, stored

MOST_EXPOSURES, MOST_PATH = 100, 32
#: Larger plans are refused. Fixed values of the plan contract; they bound what one plan costs a task.
MOST_NODES, MOST_EDGES = 4096, 16384
#: The kind that a plan document names; what stands before the dot is its producer's.
PLAN_KIND = r"^[^\s.]+\.control-plan\z"
MOST_BYTES = 1 << 20
NODE_KINDS = ("start", "agent", "router", "fanout", "join", "validator", "end")
EDGE_KINDS = ("always", "success", "failure", "fallback", "fanout", "join")
QUALIFIED = r"^[^:\s]+::[^:\s]+\z"

_CREDENTIAL = (is_credential_identity, "must not hold a credential")
_ID = Text(1, 256, r"^\S+\z", checks=(_CREDENTIAL,))
_PRODUCER = Text(1, 128, r"^\S+\z", checks=(_CREDENTIAL,))


def _of(m: Column, name: str, kind: str) -> Column:
    """A field of an object, null where it is absent."""
    return F.try_variant_get(F.try_element_at(m, F.lit(name)), "$", kind)


def _has(m: Column, name: str) -> Column:
    return F.map_contains_key(m, name)


BOUNDS = ("max_invocations", "max_parallelism", "timeout_seconds")


def _all_of(m: Column, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [_has(m, n) for n in names])


def _any_of(m: Column, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [_has(m, n) for n in names])


def _calls(m: Column) -> Column:
    return _of(m, "agent_call", "boolean")


def _members(m: Column) -> Column:
    return texts(as_list(F.try_element_at(m, F.lit("principals"))))


_NODE = Fields(
    {
        "id": _ID, "kind": Text(values=NODE_KINDS), "principals": Items(Text(checks=(_CREDENTIAL,)), most=256), "agent_call": Flag(), **{b: Whole(1) for b in BOUNDS}, "validator_scope": Text(values=("workspace_result",)),
    },
    required=("id", "kind", "principals", "agent_call"),
    checks=(
        (lambda m: (_of(m, "kind", "string") == "agent") != _calls(m), "kind and agent_call disagree"),
        (lambda m: repeats(_members(m)), "names a principal twice"),
        (lambda m: _calls(m) & (F.size(_members(m)) == 0), "calls an agent without a principal"),
        (lambda m: _calls(m) & ~_all_of(m, BOUNDS), "calls an agent without all bounds"),
        (lambda m: _calls(m) & (_of(m, "max_parallelism", "long") > _of(m, "max_invocations", "long")), "runs more at once than in all"),
        (lambda m: ~_calls(m) & _any_of(m, BOUNDS), "has bounds but calls no agent"),
        (lambda m: (_of(m, "kind", "string") == "validator") != _has(m, "validator_scope"), "validators, and only they, have a scope"),
    ),
)
_EDGE = Fields(
    {"from": _ID, "to": _ID, "kind": Text(values=EDGE_KINDS), "decided_by": Text(values=("code", "model", "human")), "max_fan_out": Whole(1)},
    required=("from", "to", "kind", "decided_by"),
    checks=((lambda m: (_of(m, "kind", "string") != "fanout") & _has(m, "max_fan_out"), "bounds the fan-out of a plain edge"),),
)
_WHO = Fields(
    {
        "id": _ID,
        "candidate_tools": Items(
            Text(), 1, 4096,
            checks=(
                (lambda xs: ~F.forall(texts(xs), lambda t: t.rlike(QUALIFIED)), "must be server::tool keys"),
                (lambda xs: F.exists(texts(xs), is_credential_identity), "must not hold a credential"),
                (lambda xs: repeats(texts(xs)), "names a tool twice"),
            ),
        ),
    },
    required=("id", "candidate_tools"),
)


def _ids(m: Column, name: str) -> Column:
    return F.transform(as_list(F.try_element_at(m, F.lit(name))), lambda x: F.try_variant_get(x, "$.id", "string"))


def _undeclared(m: Column) -> Column:
    used = F.flatten(F.transform(as_list(F.try_element_at(m, F.lit("nodes"))), lambda x: F.try_variant_get(x, "$.principals", "array<string>")))
    return F.size(F.array_except(used, _ids(m, "principals"))) > 0


#: The plan contract of major version 1; further fields are ignored.
PLAN_RULE = Fields(
    {
        "schema_version": Whole(values=(1,)), "kind": Text(pattern=PLAN_KIND), "run_id": _ID, "producer": Fields({"name": _PRODUCER, "version": _PRODUCER}, required=("name", "version")),
        "principals": Items(_WHO, 1, 256), "nodes": Items(_NODE, 1, MOST_NODES), "edges": Items(_EDGE, 0, MOST_EDGES),
        "limits": Fields({"maximum_agent_calls": Whole(1), "maximum_parallelism": Whole(1), "maximum_cycles": Whole(values=(0,))}, required=("maximum_agent_calls", "maximum_parallelism", "maximum_cycles")),
    },
    required=("schema_version", "kind", "run_id", "producer", "principals", "nodes", "edges", "limits"),
    checks=(
        (lambda m: repeats(_ids(m, "principals")), "names a principal twice"),
        (lambda m: repeats(_ids(m, "nodes")), "names a node twice"),
        (_undeclared, "a node names an undeclared principal"),
    ),
)
PLAN = (
    "struct<run_id:string,principals:array<struct<id:string,candidate_tools:array<string>>>,nodes:array<struct<id:string,kind:string,principals:array<string>,agent_call:boolean,max_invocations:bigint,max_parallelism:bigint>>,"
    "edges:array<struct<from:string,to:string,kind:string,decided_by:string,max_fan_out:bigint>>,limits:struct<maximum_agent_calls:bigint,maximum_parallelism:bigint>>"
)


@dataclass(frozen=True)
class Plans:
    plans: DataFrame
    principals: DataFrame
    nodes: DataFrame
    edges: DataFrame


def read_plans(lines: DataFrame) -> tuple[Plans, DataFrame]:
    """lines(value, ...) of JSON plans -> (tables, refused): plans under PLAN_RULE, and lines' columns plus `problem` of the others.

    Types are compared as written: "8" is no number, true neither, 8.0 is 8. A
    run_id that several plans have is left to the caller; null lines, plans
    over MOST_BYTES and names that stand twice in one object are refused.
    """
    got = cut(checked(lines, PLAN_RULE, MOST_BYTES).drop("doc"))
    ok = got.filter("problem is null").select(F.try_variant_get(F.try_parse_json("value"), "$", PLAN).alias("p")).select("p.*")
    nodes = ok.select("run_id", F.posexplode("nodes").alias("pos", "n")).select("run_id", F.col("n.id").alias("node"), F.col("n.kind").alias("kind"), F.col("n.agent_call").alias("agent_call"), F.col("n.max_invocations").alias("invocations"), F.col("n.max_parallelism").alias("parallelism"), "pos", F.col("n.principals").alias("principals"))
    edges = ok.select("run_id", F.posexplode("edges").alias("pos", "e")).select("run_id", F.col("e.from").alias("source"), F.col("e.to").alias("target"), F.col("e.kind").alias("kind"), F.col("e.decided_by").alias("decided_by"), F.col("e.max_fan_out").alias("fan_out"), "pos")
    who = ok.select("run_id", F.explode("principals").alias("p")).select("run_id", F.col("p.id").alias("principal"), F.explode("p.candidate_tools").alias("tool"))
    plans = ok.select("run_id", F.col("limits.maximum_agent_calls").alias("max_calls"), F.col("limits.maximum_parallelism").alias("max_parallel"))
    return Plans(plans, who, nodes, edges), got.filter("problem is not null")


def _finding(rows: DataFrame, code: str, subject: Column) -> DataFrame:
    return rows.select("run_id", F.lit(code).alias("code"), subject.alias("subject"))


def field_findings(p: Plans) -> DataFrame:
    """Fields that contradict each other, and names used twice or not declared."""
    n, e = p.nodes, p.edges
    is_agent = F.col("kind") == "agent"
    bounds = F.col("invocations").isNotNull() | F.col("parallelism").isNotNull()
    parts = [
        _finding(n.filter(is_agent != F.col("agent_call")), "agent_flag", F.col("node")),
        _finding(n.filter(F.col("agent_call") & ~(F.col("invocations").isNotNull() & F.col("parallelism").isNotNull())), "call_without_bounds", F.col("node")),
        _finding(n.filter(~F.col("agent_call") & bounds), "bounds_without_call", F.col("node")),
        _finding(n.groupBy("run_id", "node").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_node", F.col("node")),
        _finding(e.filter((F.col("kind") != "fanout") & F.col("fan_out").isNotNull()), "fan_out_on_plain_edge", F.concat_ws(">", "source", "target")),
        _finding(p.principals.filter(~F.contains("tool", F.lit("::"))), "unqualified_tool", F.col("tool")),
        _finding(p.principals.groupBy("run_id", "principal", "tool").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_tool", F.col("tool")),
    ]
    if "principals" in n.columns:
        used = n.select("run_id", "node", F.explode("principals").alias("principal"))
        parts.append(_finding(used.join(p.principals, ["run_id", "principal"], "left_anti"), "undeclared_principal", F.col("principal")))
    return reduce(DataFrame.unionByName, parts)


#: Names that a plan must not carry, as it holds no message bodies, and parts of names. Fixed values of the plan contract.
BODY_FIELDS = (
    "api_key", "body", "command", "commands", "credential", "credentials", "env", "gate_commands", "headers", "memory", "model_selector", "output", "outputs",
    "password", "patch", "prompt", "prompts", "repo_root", "repository_path", "secret", "stderr", "stdout", "token", "worktree",
)
BODY_PARTS = ("api_key", "command", "credential", "memory_body", "model_selector", "output", "password", "patch", "prompt", "secret", "stderr", "stdout", "token")
ABSOLUTE_PATH = r"^(?:/|\\\\|[A-Za-z]:[\\/])"
#: Deeper plans are refused.
MOST_DEPTH = 100


def body_findings(documents: DataFrame) -> DataFrame:
    """documents(run_id, value JSON) -> findings of forbidden names, credential-shaped names and strings, and absolute paths.

    A loop over levels until one is empty. Values beyond MOST_DEPTH levels give
    a nesting finding, and values that are no JSON (deeper than the parser
    reads, or with a name twice) one of their own. Credential-shaped names are
    never shown.
    """
    got = documents.select("run_id", F.try_parse_json("value").alias("v"))
    found = [_finding(got.filter("v is null"), "not_json", F.lit(""))]
    level, depth = cut(got.filter("v is not null").select("run_id", F.lit(None).cast("string").alias("key"), "v")), 0
    while not level.isEmpty():
        if depth > MOST_DEPTH:
            found.append(_finding(level.select("run_id").distinct(), "nesting", F.lit(str(MOST_DEPTH))))
            break
        low, secret = F.lower("key"), is_credential_identity(F.col("key"))
        barred = F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in BODY_PARTS], low.isin(*BODY_FIELDS)), F.lit(False))
        text = F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string"))
        codes = F.array_compact(
            F.array(
                F.when(F.col("secret"), "credential_key"),
                F.when(F.col("barred") & ~F.col("secret"), "forbidden_field"),
                F.when(is_credential_shaped(F.col("text")), "credential_value"),
                F.when(F.col("text").rlike(ABSOLUTE_PATH), "absolute_path"),
            )
        )
        rows = level.select("run_id", secret.alias("secret"), barred.alias("barred"), text.alias("text"), F.coalesce("key", F.lit("")).alias("key"))
        found.append(rows.select("run_id", F.explode(codes).alias("code"), F.when(F.col("secret"), "").otherwise(F.col("key")).alias("subject")))
        depth += 1
        parts = level.select("run_id", F.col("v").alias("up"))
        level = cut(parts.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("up").outer())).select("run_id", "key", F.col("value").alias("v")))
    return reduce(DataFrame.unionByName, found)


def start_end(p: Plans) -> DataFrame:
    per = p.plans.select("run_id").join(p.nodes, "run_id", "left").groupBy("run_id").agg(F.count_if(F.col("kind") == "start").alias("s"), F.count_if(F.col("kind") == "end").alias("e"))
    return _finding(per.filter("s <> 1"), "start_count", F.col("s").cast("string")).unionByName(_finding(per.filter("e <> 1"), "end_count", F.col("e").cast("string")))


def unknown_nodes(p: Plans) -> DataFrame:
    ends = p.edges.select("run_id", F.col("source").alias("node")).union(p.edges.select("run_id", "target")).distinct()
    return _finding(ends.join(p.nodes, ["run_id", "node"], "left_anti"), "unknown_node", F.col("node"))


Steps = dict[str, set[str]]


def _each_plan(edges: DataFrame, asked: DataFrame, walk: Callable[[Steps, list], Iterator[tuple]], schema: str) -> DataFrame:
    """run_id and the rows of walk(steps, values) for each plan of asked(run_id, values).

    A plan is small by contract, so its edges are collected beside it and many
    plans share an Arrow batch: one shuffle, whatever the length of paths.
    """
    steps = edges.groupBy("run_id").agg(F.collect_set(F.struct("source", "target")).alias("steps"))
    out = T.StructType.fromDDL(f"run_id string, {schema}")
    types = [to_arrow_type(f.dataType) for f in out]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for plan in batch.to_pylist():
                after: Steps = {}
                for e in plan["steps"] or ():
                    after.setdefault(e["source"], set()).add(e["target"])
                for row in walk(after, plan["values"]):
                    rows.append((plan["run_id"], *row))
                    if len(rows) >= 50_000:
                        yield pack(rows)
                        rows = []
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=out.fieldNames())

    return asked.select("run_id", "values").join(steps, "run_id", "left").mapInArrow(run, out)


def _values(rows: DataFrame, *columns: str) -> DataFrame:
    """(run_id, values): the distinct values of columns of each plan."""
    return rows.groupBy("run_id").agg(F.collect_set(F.struct(*columns)).alias("values"))


def _layers(after: Steps, seed: str) -> Iterator[list[tuple[str, str]]]:
    """(node, node before it) by distance from the seed; each layer in the order of its least paths by name."""
    seen, layer = {seed}, [seed]
    while layer:
        new = []
        for u in layer:
            for v in sorted(after.get(u, ())):
                if v not in seen:
                    seen.add(v)
                    new.append((v, u))
        yield new
        layer = [v for v, _ in new]


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(run_id, seed, node, depth): nodes on a path from each seed, at their least depth; seeds at 0."""

    def walk(after: Steps, values: list) -> Iterator[tuple]:
        for seed in (v["node"] for v in values):
            yield seed, seed, 0
            for depth, layer in enumerate(_layers(after, seed), 1):
                yield from ((seed, v, depth) for v, _ in layer)

    return _each_plan(edges, _values(seeds, "node"), walk, "seed string, node string, depth int")


FAR = np.iinfo(np.uint16).max


class Distances:
    """How far every node of a plan is from each of some targets, by bit sets of targets.

    Strongly connected components reach the same targets, so one closure over
    the components in their order tells which nodes matter at all; only these
    are walked. A round moves every node's set of newly met targets one edge
    back, all targets at once.
    """

    def __init__(self, after: Steps, targets: list[str]):
        names = sorted({*after, *targets, *(v for vs in after.values() for v in vs)})
        self.names, self.targets = names, {t: i for i, t in enumerate(targets)}
        self.number = number = {v: i for i, v in enumerate(names)}
        self.next = [sorted(number[v] for v in after.get(u, ())) for u in names]  # numbers sort like names
        n, words = len(names), (len(targets) + 63) // 64
        self.far = np.full((n, len(targets)), FAR, dtype=np.uint16)
        bits = np.zeros((n, words), dtype=np.uint64)
        for t, i in self.targets.items():
            bits[number[t], i // 64] |= np.uint64(1 << (i % 64))
            self.far[number[t], i] = 0
        matters = self._closure(bits)
        edges = [(u, v) for u in range(n) if matters[u] for v in self.next[u] if matters[v]]
        if not edges:
            return
        ends = np.array([v for _, v in edges])
        heads, begins = np.unique([u for u, _ in edges], return_index=True)
        seen, fresh, depth = bits.copy(), bits, 0
        while fresh.any():
            depth += 1
            met = np.zeros_like(bits)
            met[heads] = np.bitwise_or.reduceat(fresh[ends], begins, axis=0)
            fresh = met & ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh.any(axis=1))
            hit = np.unpackbits(fresh[rows].view(np.uint8), axis=1, bitorder="little")[:, : len(targets)].astype(bool)
            at, which = np.nonzero(hit)
            self.far[rows[at], which] = depth

    def _closure(self, own: np.ndarray) -> list[bool]:
        """Whether any target lies on or ahead of each node, by components in reverse order."""
        part = components(self.next)
        ahead = [own[0] * 0 if len(own) else None] * (max(part, default=-1) + 1)
        members: list[list[int]] = [[] for _ in ahead]
        for v, c in enumerate(part):
            members[c].append(v)
        for c, nodes in enumerate(members):  # what a component leads to has smaller numbers
            total = np.bitwise_or.reduce(own[nodes], axis=0)
            for v in nodes:
                for w in self.next[v]:
                    if part[w] != c:
                        total = total | ahead[part[w]]
            ahead[c] = total
        return [bool(ahead[c].any()) for c in part]

    def path(self, source: str, target: str) -> list[str]:
        """A shortest path, the least by name: of the nodes one step nearer, the first by name each time."""
        t, at = self.targets[target], self.number[source]
        out = [source]
        for left in range(int(self.far[at, t]) - 1, -1, -1):
            at = next(v for v in self.next[at] if self.far[v, t] == left)
            out.append(self.names[at])
        return out


def components(after: list[list[int]]) -> list[int]:
    """The number of each node's strongly connected component; a component leads only to itself and smaller numbers."""
    order, low, part = [-1] * len(after), [0] * len(after), [-1] * len(after)
    count = found = 0
    held: list[int] = []
    for root in range(len(after)):
        if order[root] >= 0:
            continue
        calls = [(root, 0)]
        while calls:
            v, i = calls.pop()
            if i == 0:
                order[v] = low[v] = count
                count += 1
                held.append(v)
            elif part[after[v][i - 1]] < 0:
                low[v] = min(low[v], low[after[v][i - 1]])
            while i < len(after[v]):
                w = after[v][i]
                i += 1
                if order[w] < 0:
                    calls.append((v, i))
                    calls.append((w, 0))
                    break
                if part[w] < 0:
                    low[v] = min(low[v], order[w])
            else:
                if low[v] == order[v]:
                    while part[v] < 0:
                        part[held.pop()] = found
                    found += 1
    return part


def flows(edges: DataFrame, readers: DataFrame, writers: DataFrame, paths: bool = False) -> DataFrame:
    """(run_id, reader, writer, depth) of (run_id, node) tables: writers that a path leads to from another node, a reader; with `path` if asked.

    One walk gives both. A path is a shortest one, the least by name.
    """
    asked = readers.select("run_id", "node", F.lit(False).alias("end")).union(writers.select("run_id", "node", F.lit(True)))

    def walk(after: Steps, values: list) -> Iterator[tuple]:
        targets = sorted(v["node"] for v in values if v["end"])
        seeds = sorted(v["node"] for v in values if not v["end"])
        if not targets or not seeds:
            return
        known = Distances(after, targets)
        for seed in seeds:
            if seed not in known.number:
                continue
            far = known.far[known.number[seed]]
            for i in np.flatnonzero((far < FAR) & (far > 0)):
                row = (seed, targets[i], int(far[i]))
                yield (*row, known.path(seed, targets[i])) if paths else row

    return _each_plan(edges, _values(asked, "node", "end"), walk, "reader string, writer string, depth int" + (", path array<string>" if paths else ""))


def _single(p: Plans, kind: str) -> DataFrame:
    one = p.nodes.filter(F.col("kind") == kind).groupBy("run_id").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return one.filter("n = 1").select("run_id", "node")


def unreachable(p: Plans) -> DataFrame:
    start = _single(p, "start")
    hit = reach(p.edges, start).select("run_id", "node")
    return _finding(p.nodes.join(start.select("run_id"), "run_id", "left_semi").join(hit, ["run_id", "node"], "left_anti"), "unreachable", F.col("node"))


def no_terminal_path(p: Plans) -> DataFrame:
    end = _single(p, "end")
    back = p.edges.select("run_id", F.col("target").alias("source"), F.col("source").alias("target"))
    hit = reach(back, end).select("run_id", "node")
    return _finding(p.nodes.join(end.select("run_id"), "run_id", "left_semi").join(hit, ["run_id", "node"], "left_anti"), "no_terminal_path", F.col("node"))


def cycles(p: Plans) -> DataFrame:
    """Nodes left after peeling those without incoming edges."""

    def walk(after: Steps, values: list) -> Iterator[tuple]:
        left = {v["node"] for v in values}
        into = dict.fromkeys(left, 0)
        for u in left:
            for v in after.get(u, ()):
                if v in left:
                    into[v] += 1
        free = [v for v, n in into.items() if not n]
        while free:
            u = free.pop()
            left.discard(u)
            for v in after.get(u, ()):
                if v in left:
                    into[v] -= 1
                    if not into[v]:
                        free.append(v)
        return ((v,) for v in left)

    return _finding(_each_plan(p.edges, _values(p.nodes, "node"), walk, "node string"), "cycle", F.col("node"))


def unbounded_fanout(p: Plans) -> DataFrame:
    return _finding(p.edges.filter("kind = 'fanout' and decided_by = 'model' and fan_out is null"), "model_fanout_unbounded", F.concat_ws(">", "source", "target"))


def call_bound(p: Plans) -> DataFrame:
    total = p.nodes.groupBy("run_id").agg(F.sum("invocations").alias("n"))
    return _finding(total.join(p.plans, "run_id").filter("n > max_calls"), "call_bound", F.col("n").cast("string"))


def parallel_bound(p: Plans) -> DataFrame:
    most = p.nodes.groupBy("run_id").agg(F.max("parallelism").alias("n"))
    return _finding(most.join(p.plans, "run_id").filter("n > max_parallel"), "parallel_bound", F.col("n").cast("string"))


def lint(p: Plans) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(p) for f in (start_end, unknown_nodes, unreachable, no_terminal_path, cycles, unbounded_fanout, call_bound, parallel_bound)])


def principal_decisions(p: Plans, graph: Graph, profile: str = "strict") -> DataFrame:
    """(run_id, principal, tool, tool_key, reason): the selector's decision for each candidate of each principal."""
    asked = p.principals.select("run_id", F.col("principal").alias("agent"), F.col("tool").alias("ref"))
    features = selector.rank_features(graph, asked.withColumn("pos", F.lit(1)), keep=("run_id",), evidence=False)
    got = selector.filter_features(features, profile).select("run_id", F.col("agent").alias("principal"), F.col("candidate").alias("tool"), "tool_key", "reason")
    lost = asked.join(graph.agents.select(F.col("id").alias("agent")), "agent", "left_anti")
    none = F.lit(None).cast("string").alias("tool_key")
    return got.unionByName(lost.select("run_id", F.col("agent").alias("principal"), F.col("ref").alias("tool"), none, F.lit("AGENT_NOT_FOUND").alias("reason")))


def _acts(callers: DataFrame, graph: Graph, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, writes) that the callers' eligible tools make."""
    fine = decisions.filter("reason is null").select("run_id", "principal", "tool_key")
    # What a tool touches comes before its callers, which multiply rows.
    used = fine.join(graph.data_access.select("tool_key", "mode", "uri"), "tool_key")
    acts = callers.join(used, ["run_id", "principal"]).select("run_id", "node", "tool_key", "mode", "uri").distinct()
    acts = stored(acts)
    reads = acts.filter("mode = 'READS'").select("run_id", F.col("node").alias("reader"), F.col("tool_key").alias("read_tool"), F.col("uri").alias("read_uri"))
    return reads, acts.filter("mode = 'WRITES'").select("run_id", F.col("node").alias("writer"), F.col("tool_key").alias("write_tool"), F.col("uri").alias("write_uri"))


def exposures(p: Plans, callers: DataFrame, graph: Graph, decisions: DataFrame, paths: bool = False) -> DataFrame:
    """(run_id, reader, writer, depth, read_tool, read_uri, write_tool, write_uri): reads that can flow into later writes; with the witness path if asked.

    callers(run_id, node, principal). Only nodes that read are sources, and
    only nodes that write are looked for.
    """
    reads, writes = _acts(callers, graph, decisions)
    pairs = flows(p.edges, reads.select("run_id", F.col("reader").alias("node")), writes.select("run_id", F.col("writer").alias("node")), paths)
    shown = pairs.withColumn("path", compressed(F.col("path"))) if paths else pairs
    return shown.join(writes, ["run_id", "writer"]).join(reads, ["run_id", "reader"]).select("run_id", "reader", "writer", "depth", "read_tool", "read_uri", "write_tool", "write_uri", *(["path"] if paths else []))


def witness_paths(p: Plans, pairs: DataFrame) -> DataFrame:
    """(run_id, reader, writer, path): a shortest path of each asked pair, the least by name, long ones shortened in the middle."""

    def walk(after: Steps, values: list) -> Iterator[tuple]:
        known = Distances(after, sorted({v["writer"] for v in values}))
        for v in values:
            reader, writer = v["reader"], v["writer"]
            if reader in known.number and 0 < known.far[known.number[reader], known.targets[writer]] < FAR:
                yield reader, writer, known.path(reader, writer)

    found = _each_plan(p.edges, _values(pairs, "reader", "writer"), walk, "reader string, writer string, path array<string>")
    return found.withColumn("path", compressed(F.col("path")))


def compressed(path: Column) -> Column:
    """At most 32 entries: the head, one entry that says how many are left out, and the tail."""
    head = MOST_PATH // 2
    tail = MOST_PATH - head - 1
    gap = F.array(F.format_string("... (%d intermediate nodes) ...", F.size(path) - head - tail))
    return F.when(F.size(path) <= MOST_PATH, path).otherwise(F.concat(F.slice(path, 1, head), gap, F.slice(path, -tail, tail)))


def capped(rows: DataFrame, nodes: DataFrame, most: int = MOST_EXPOSURES) -> DataFrame:
    """The first records per plan by reader position, depth and writer position, with the number of all and whether some are left out."""
    at = nodes.groupBy("run_id", "node").agg(F.min("pos").alias("pos"))
    got = rows.join(at.select("run_id", F.col("node").alias("reader"), F.col("pos").alias("_r")), ["run_id", "reader"]).join(at.select("run_id", F.col("node").alias("writer"), F.col("pos").alias("_w")), ["run_id", "writer"])
    place = Window.partitionBy("run_id").orderBy("_r", "depth", "_w", "read_tool", "read_uri", "write_tool", "write_uri")
    n = rows.groupBy("run_id").agg(F.count("*").alias("pairs"))
    shown = got.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= most)
    return shown.join(n, "run_id").withColumn("truncated", F.col("pairs") > most).drop("_r", "_w")


def plan_decisions(p: Plans, findings: DataFrame, decisions: DataFrame, flows: DataFrame) -> DataFrame:
    """(run_id, decision): advisory_warn on findings, rejects, unknown agents or exposures."""
    bad = findings.select("run_id").union(decisions.filter("reason is not null").select("run_id")).union(flows.select("run_id")).distinct().withColumn("_b", F.lit(True))
    return p.plans.select("run_id").join(bad, "run_id", "left").select("run_id", F.when(F.col("_b"), "advisory_warn").otherwise("advisory_allow").alias("decision"))
