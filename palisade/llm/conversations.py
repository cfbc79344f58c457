"""Repair of conversation structure by a square-root checkpointed dynamic program.

A conversation's roles must spell `(s?(ua)+)?`. Rows may be kept, given
another role, deleted, or joined by inserted ones, each at a cost. Backward
cost vectors (one cost per grammar state) are stored at checkpoints only, about
the square root of the rows apart; walking forward, a block's vectors are
computed again from its checkpoint, and of the cheapest edits the one of least
letter is taken.

Rows lie in tasks by ranges of (conversation, turn), so a conversation may
span tasks. Each task sums up the conversations at its two edges as cost
matrices between states; the products of these, two per task at most, give
every piece its cost vector behind and its state before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.spans import CRC_TABLE_SQL, crc32_sql, cut, text_key

#: States: nothing read, after s, after u, after a. The user or assistant that may come next, and the state after it.
USER, ASSISTANT = "user", "assistant"
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
#: What a kept row's initial does to a state.
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 60
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults put in by a hash of conv_id and turn; nulls of role and text become one space.

    `copies` is how often a row stands there: 0 (dropped), 1 or 2.
    """
    filled = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", F.when(fault == 4, USER).otherwise(filled("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def conversation_key(conv_id: Column) -> Column:
    """A string that is never null."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


ROW = ("key", "turn", "role", "k1", "k2")


def faulty(rows: DataFrame) -> DataFrame:
    """One row per distinct (key, turn, role, text): `n` copies of it and the first copy's fault; later copies are duplicates.

    Copies are counted before any shuffle, and rows of equal role and text
    meet as one row per turn, so a row repeated without end stays one row.
    """
    k1, k2 = text_key(F.col("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    slim = rows.filter("copies > 0").select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn"), "role", k1.alias("k1"), k2.alias("k2"), F.left("text", F.lit(32)).alias("head"), fault.alias("fault"), "copies")
    slim = slim.groupBy(*ROW, "head", "fault").agg(F.sum("copies").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = slim.groupBy("key", "role", "k1", "k2").agg(F.min(when).alias("first"))
    again = F.when((F.col("fault") != BLANK) & (when > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return slim.join(first, ["key", "role", "k1", "k2"]).select(*ROW, "head", "n", again.alias("fault"))


# ---- The dynamic program -----------------------------------------------------


def with_inserts(v: Vector) -> Vector:
    """Costs when rows may be inserted first."""
    b = min(v[2], INSERT + v[3])
    c = min(v[3], INSERT + v[2])
    return min(v[0], INSERT + b), min(v[1], INSERT + b), b, c


END: Vector = with_inserts((0, FAR, FAR, 0))


def moves(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, in order of the edits' letters; insertions aside."""
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = CUT_SHORT if fault == TRUNCATED else 0
        if (initial, state) in KEEP:
            out.append(("K", more, KEEP[initial, state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


TABLE = {(i, f): tuple(tuple(moves(i, f, s)) for s in range(4)) for i in ("s", "u", "a", "") for f in range(4)}


def before(row: tuple[str, int], behind: Vector) -> Vector:
    """Cost vector before a row, from the one behind it."""
    return with_inserts(tuple(min(cost + behind[t] for _, cost, t in ways) for ways in TABLE[row]))


def matrix(rows: list[tuple[str, int]]) -> list[Vector]:
    """The least cost from each state before the rows (first insertions included) to each state behind them, column by column."""
    out = []
    for t in range(4):
        v = tuple(0 if s == t else FAR for s in range(4))
        for r in reversed(rows):
            v = before(r, v)
        out.append(v)
    return out


def joined(columns: list[Vector], behind: Vector) -> Vector:
    return tuple(min(columns[t][s] + behind[t] for t in range(4)) for s in range(4))


def walk(rows: list[tuple[str, int]], behind: Vector, state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """The cheapest edits of least letters, as (edit, row number, state behind), from a state to a cost vector behind the rows.

    Vectors are kept at every checkpoint, and between two of them only while
    that block is walked: twice the square root of the rows, not all rows.
    An insertion names the row that it stands before.
    """
    n = len(rows)
    step = max(1, int(n**0.5))
    marks, v = {n: behind}, behind
    for i in range(n - 1, -1, -1):
        v = before(rows[i], v)
        if i % step == 0:
            marks[i] = v
    for begin in range(0, n, step):
        end = min(begin + step, n)
        block = [marks[end]]
        for i in range(end - 1, begin - 1, -1):
            block.append(before(rows[i], block[-1]))
        block.reverse()
        for i in range(begin, end):
            here, there = block[i - begin], block[i - begin + 1]
            while True:
                first, *others = TABLE[rows[i]][state]  # D, then K and R
                ways = (first, ("I", INSERT, NEXT[state]), *others)
                edit, _, state = next(m for m in ways if m[1] + (here if m[0] == "I" else there)[m[2]] == here[state])
                yield edit, i, state
                if edit != "I":
                    break
    while last and state not in ENDS:
        state = NEXT[state]
        yield "I", n, state


def row_of(role: str, fault: int) -> tuple[str, int]:
    return role[:1] if role[:1] in ("s", "u", "a") else "", fault


# ---- Pieces of conversations in tasks ------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """(key, its rows in this task); a task's rows are sorted by key."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key and held:
                yield key, held
                held = []
            key = r["key"]
            held.append(r)
    if held:
        yield key, held


def _expanded(held: list[dict]) -> list[tuple[str, int]]:
    out = []
    for r in held:
        out.append(row_of(r["role"], r["fault"]))
        later = BLANK if r["fault"] == BLANK else DUPLICATE
        out += [row_of(r["role"], later)] * (r["n"] - 1)
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last piece of a task: cost matrix and outer initials."""
    first = last = None
    task = None
    out: dict[str, list] = {c: [] for c in ("task", "place", "key", "costs", "head", "tail")}

    def add(place: int, key: str, held: list[dict]) -> None:
        for c, x in zip(out, (task, place, key, [x for v in matrix(_expanded(held)) for x in v], held[0]["role"][:1], held[-1]["role"][:1]), strict=True):
            out[c].append(x)

    for key, held in _pieces(batches):
        if first is None:
            first, task = key, held[0]["at"] >> 33
            add(0, key, held)
        else:
            last = (key, held)
    if last:
        add(1, *last)
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int64()) if c == "costs" else pa.int64() if c in ("task", "place") else pa.string()) for c, v in out.items()], names=list(out))


def _spans(edges: list) -> tuple[dict, list[list]]:
    """{(task, key): [cost vector behind, initial before, whether it is the last piece]} of pieces with neighbours, and their chains."""
    chains: list[list] = []
    for e in sorted(edges, key=lambda e: (e.task, e.place)):
        if chains and chains[-1][-1].key == e.key:
            chains[-1].append(e)
        else:
            chains.append([e])
    known = {}
    for chain in (c for c in chains if len(c) > 1):
        behind = END
        for j in reversed(range(len(chain))):
            e = chain[j]
            known[e.task, e.key] = [behind, chain[j - 1].tail if j else None, j == len(chain) - 1]
            behind = joined([tuple(e.costs[4 * t : 4 * t + 4]) for t in range(4)], behind)
    return known, [c for c in chains if len(c) > 1]


EDITS = "key string, seq long, edit string, turn {turn}, role string, was string, k1 long, k2 long, piece string, cost long, illegal long"
GOOD_PAIRS = ("su", "ua", "au")


def repair(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The edits of every conversation, and one summary row per conversation and task.

    rows: conv_id, turn, role, text, copies. An edit row has key, seq (ascending
    in a conversation), edit (D, I, K, R), turn, role (after the edit), was
    (before it), k1 and k2 (of the text). A summary row has edit null, its
    part of the audit in `piece`, its `cost` and its `illegal` pairs. Rows of a
    turn go by role, then text; null turns come first; a null conv_id is a
    conversation of its own. Empty tables give no rows. found: faulty(rows),
    if the caller has it.
    """
    order = ("key", "turn", "role", "head", "k1", "k2")
    found = faulty(rows) if found is None else found
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(dealt.withColumn("at", F.monotonically_increasing_id()))
    # Two rows per task at most reach the driver, whatever the tasks hold.
    edges = held.mapInArrow(_edges, "task long, place long, key string, costs array<long>, head string, tail string").collect()
    known, chains = _spans(edges)
    states: dict = {}
    if chains:
        asked = {x: v[0] for x, v in known.items()}

        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {"task": [], "key": [], "states": []}
            for key, own in _pieces(batches):
                task = own[0]["at"] >> 33
                if (task, key) in asked:
                    codes = _expanded(own)
                    out["task"].append(task)
                    out["key"].append(key)
                    ends = []
                    for state in range(4):
                        behind = state
                        for _, _, behind in walk(codes, asked[task, key], state, False):  # noqa: B007
                            pass
                        ends.append(behind)
                    out["states"].append(ends)
            yield pa.RecordBatch.from_arrays([pa.array(out["task"], pa.int64()), pa.array(out["key"], pa.string()), pa.array(out["states"], pa.list_(pa.int64()))], names=list(out))

        to = {(r.task, r.key): r.states for r in held.mapInArrow(ways, "task long, key string, states array<long>").collect()}
        for chain in chains:
            state = 0
            for e in chain:
                states[e.task, e.key] = state
                state = to[e.task, e.key][state]
    schema = EDITS.format(turn=rows.schema["turn"].dataType.simpleString())
    turn_type = held.select("turn").limit(0).toArrow().schema.field("turn").type

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "seq", "edit", "turn", "role", "was", "k1", "k2", "piece", "cost", "illegal")
        types = (pa.string(), pa.int64(), pa.string(), turn_type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        out: list[list] = [[] for _ in names]

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=list(names))
            for v in out:
                v.clear()
            return made

        def add(*values) -> None:
            for v, x in zip(out, values, strict=True):
                v.append(x)

        seq = 0
        for key, own in _pieces(batches):
            task = own[0]["at"] >> 33
            behind, initial, last = known.get((task, key), (END, None, True))
            codes = _expanded(own)
            source = [r for r in own for _ in range(r["n"])]
            pairs = [*([initial] if initial is not None else []), *(r["role"][:1] for r in source)]
            illegal = sum(a + b not in GOOD_PAIRS for a, b in zip(pairs, pairs[1:], strict=False))
            letters, cost = [], 0
            for edit, i, state in walk(codes, behind, states.get((task, key), 0), last):
                letters.append(edit)
                seq += 1
                spot = task << 40 | seq
                if edit == "I":
                    add(key, spot, edit, None, USER if state == 2 else ASSISTANT, None, None, None, None, None, None)
                    cost += INSERT
                else:
                    r = source[i]
                    role = (USER if state == 2 else ASSISTANT) if edit == "R" else r["role"]
                    add(key, spot, edit, r["turn"], role, r["role"], r["k1"], r["k2"], None, None, None)
                    cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (CUT_SHORT if codes[i][1] == TRUNCATED else 0)
                if len(out[0]) >= 10_000:
                    yield full()
            add(key, task, None, None, None, None, None, None, "".join(letters), cost, illegal)
        yield full()

    return held.mapInArrow(emit, schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, seq, edit, turn, role, text) of the repaired conversations: kept, re-roled and inserted rows."""
    k1, k2 = text_key(F.col("text"))
    texts = rows.filter("copies > 0").select(conversation_key(F.col("conv_id")).alias("key"), "turn", F.col("role").alias("was"), k1.alias("k1"), k2.alias("k2"), "text")
    texts = texts.groupBy("key", F.col("turn").isNull().alias("none"), F.coalesce("turn", F.lit(0)).alias("turn_or"), "was", "k1", "k2").agg(F.any_value("text").alias("text"))
    own = edits.filter("edit in ('K', 'R')").select("key", "seq", "edit", "turn", "role", "was", "k1", "k2", F.col("turn").isNull().alias("none"), F.coalesce("turn", F.lit(0)).alias("turn_or"))
    stay = own.join(texts, ["key", "none", "turn_or", "was", "k1", "k2"]).select("key", "seq", "edit", "turn", "role", "text")
    return stay.unionByName(edits.filter("edit = 'I'").select("key", "seq", "edit", "turn", "role", F.lit("").alias("text")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's role:text lines; rows come sorted by key and place, so one running digest is enough."""
    key = running = None
    keys: list[str] = []
    sums: list[str] = []
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
            if k != key:
                if running:
                    keys.append(key)
                    sums.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "repaired_sha256"])
        keys, sums = [], []
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([running.hexdigest()], pa.string())], names=["key", "repaired_sha256"])


def repair_summary(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the table: what damage left to repair, and the repair.

    Columns beyond conv_id, turn, role and text are not read.
    """
    rows = damaged(conversations)
    slim = cut(faulty(rows))
    edits = cut(repair(rows, slim))
    digests = repaired(rows, edits).select("key", "seq", "role", "text").repartition("key").sortWithinPartitions("key", "seq").select("key", "role", "text").mapInArrow(_digests, "key string, repaired_sha256 string")
    parts = edits.filter("edit is null").groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal")
    )
    n_of = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("n")).otherwise(0))
    later = F.sum(F.when(F.col("fault").isin(FINE, TRUNCATED), F.col("n") - 1).otherwise(0))
    counts = slim.groupBy("key", "turn").agg(n_of(BLANK).alias("blank"), (n_of(DUPLICATE) + later).alias("duplicate"), F.count_if(F.col("fault") == TRUNCATED).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = counts.groupBy("key").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    every = conversations.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    got = every.join(counts, "key", "left").join(parts, "key", "left").join(digests, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _vector_sql() -> str:
    """The vector before a row with initial `i`, fault `f` and extra cost `m`, from the vector v behind it."""
    free = "f in (0, 3)"
    keep = {s: [(i, t) for (i, at), t in KEEP.items() if at == s] for s in range(4)}
    ways = []
    for s in range(4):
        kept = " ".join(f"when i = '{i}' then m + v[{t + 1}]" for i, t in keep[s])
        ways.append(f"case when {free} then least({DELETE} + v[{s + 1}], {REROLE} + m + v[{NEXT[s] + 1}], case {kept} else {FAR} end) else {DELETE} + v[{s + 1}] end")
    return ", ".join(f"{w} as r{s}" for s, w in enumerate(ways))


_INSERTED = f"[least(r0, {INSERT} + least(r2, {INSERT} + r3)), least(r1, {INSERT} + least(r2, {INSERT} + r3)), least(r2, {INSERT} + r3), least(r3, {INSERT} + r2)]"
_NEXT = "case s when 2 then 3 else 2 end"
_KEPT = "case " + " ".join(f"when i = '{i}' and s = {at} then {t}" for (i, at), t in KEEP.items()) + " end"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CONVERSATIONS_SQL = f"""
with recursive {CRC_TABLE_SQL},
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h from conversations, crc),
d as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case h when 0 then 0 when 3 then 2 else 1 end)) as copy from c),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k, count(*) over (partition by conv_id) as n,
      rtrim(text, {_WHITE}) as e from d),
q as (select *, row_number() over (partition by conv_id, role, text order by k) as nth, lag(left(role, 1)) over (partition by conv_id order by k) as before from o),
w as (select *, left(role, 1) as i, case when e = '' then 1 when nth > 1 then 2 when right(e, 1) not in ('.', '!', '?') then 3 else 0 end as f from q),
x as (select *, case when f = 3 then {CUT_SHORT} else 0 end as m from w),
b as (select distinct conv_id, n + 1 as k, {list(END)}::bigint[] as v from x
      union all
      select conv_id, k, {_INSERTED}::bigint[] as v from (select x.conv_id, x.k, {_vector_sql()} from b join x on x.conv_id is not distinct from b.conv_id and x.k = b.k - 1)),
z as (select b.conv_id, b.k, b.v as here, y.v as there, x.i, x.f, x.m, x.role, x.text from b left join b y on y.conv_id is not distinct from b.conv_id and y.k = b.k + 1
      left join x on x.conv_id is not distinct from b.conv_id and x.k = b.k),
g as (select distinct conv_id, 1::bigint as k, 0 as s, '' as audit, null::varchar as said from x
      union all
      select conv_id, case edit when 'I' then k else k + 1 end, case edit when 'D' then s when 'K' then {_KEPT} else {_NEXT} end, audit || edit,
             case when edit = 'D' then said else coalesce(said || chr(10), '') || case edit when 'K' then role else case {_NEXT} when 2 then 'user' else 'assistant' end end || ':' || case edit when 'I' then '' else text end end
      from (select g.*, z.i, z.role, z.text,
                   case when {DELETE} + there[s + 1] = here[s + 1] then 'D' when {INSERT} + here[{_NEXT} + 1] = here[s + 1] then 'I'
                        when f in (0, 3) and m + there[{_KEPT} + 1] = here[s + 1] then 'K' else 'R' end as edit
            from g join z on z.conv_id is not distinct from g.conv_id and z.k = g.k where there is not null or s not in (0, 3))),
l as (select g.conv_id, audit, said from g join (select conv_id, max(k) as most from b group by conv_id) u on u.conv_id is not distinct from g.conv_id and u.most = g.k where s in (0, 3)),
t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = 1) as blank, count(*) filter (where f = 2) as duplicate, count(*) filter (where f = 3) as truncated,
             count(*) filter (where before || i not in ('su', 'ua', 'au')) as illegal from x group by conv_id),
p as (select conv_id, v[1] as cost from b where k = 1),
a as (select distinct conv_id from conversations)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from a left join t on t.conv_id is not distinct from a.conv_id left join l on l.conv_id is not distinct from a.conv_id left join p on p.conv_id is not distinct from a.conv_id
"""
