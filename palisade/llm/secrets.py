"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must contain. The index holds one posting per (text key,
trigram) for the trigrams that occur in some query. Intersecting postings by
text key gives, per rule, a superset of the texts that match; only those are
verified with the expression itself. A rule without mandatory trigrams is
verified on every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.spans import text_key, unpacked


@dataclass(frozen=True)
class Rule:
    """kind: name in the spans. regex: what to find. min_len: least code points of the group."""

    kind: str
    regex: str
    group: int = 0
    min_len: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
EXTRA_RULES = (
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

# ---- Boolean trigram queries -------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", set of queries).


def _both(kind: str, parts: list):
    """Join queries; True absorbs an or and vanishes from an and."""
    if kind == "or" and True in parts:
        return True
    flat: set = set()
    for q in parts:
        if q is not True:
            flat |= q[1] if isinstance(q, tuple) and q[0] == kind else {q}
    if kind == "or":  # a branch that asks for more than another one adds nothing
        needs = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in flat}
        flat = {q for q in flat if not any(needs[o] < needs[q] for o in flat)}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _grams(strings: set[str] | None):
    """The query for "one of these strings occurs here"."""
    if not strings:
        return True
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


_MOST = 64  #: exact string sets larger than this are given up (the query only gets weaker)


def _literals(node) -> set[str] | None:
    """The finite set of lower-cased strings a node can match; None if it is not small."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        out: set[str] = set()
        for what, value in arg:
            if what is rc.LITERAL:
                out.add(chr(value).lower())
            elif what is rc.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is rc.MAX_REPEAT and arg[1] <= 1:
        inner = _sequence_literals(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is rc.SUBPATTERN:
        return _sequence_literals(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence_literals(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    return None


def _sequence_literals(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        got = _literals(node)
        if got is None or len(out) * len(got) > _MOST:
            return None
        out = {a + b for a in out for b in got}
    return out


def _query(nodes):
    """The query of a sequence: literal runs give trigrams, the rest is descended into."""
    parts, run = [], {""}
    for node in nodes:
        got = _literals(node)
        if got is not None and len(run) * len(got) <= _MOST:
            run = {a + b for a in run for b in got}
            continue
        parts.append(_grams(run))
        run = got if got is not None else {""}
        if got is None:
            op, arg = node
            if op is rc.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif op is rc.BRANCH:
                parts.append(_both("or", [_query(b) for b in arg[1]]))
            elif op is rc.MAX_REPEAT and arg[0] >= 1:
                parts.append(_query(arg[2]))
    parts.append(_grams(run))
    return _both("and", parts)


def trigram_query(regex: str):
    """Boolean trigram query (over lower-cased text) that every match of regex satisfies."""
    return _query(rp.parse(regex))


def _trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


SPANS, CHUNK = "array<struct<start:int,o:int,end:int>>", 64
#: Tasks that the rows of one text are dealt to.
SALTS = 8

# ---- Index, candidates, verification -----------------------------------------


def vocabulary(rules) -> list[str]:
    return sorted(set().union(*(_trigrams(trigram_query(r.regex)) for r in rules)))


def build_index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """Postings (k1, k2, trigram): the given trigrams that a lower-cased text contains.

    Null texts have none. The result can be written once and searched again.
    """
    k1, k2 = text_key(F.col(text))
    low = docs.select(k1.alias("k1"), k2.alias("k2"), F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.col("_low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("k1", "k2", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules) -> DataFrame:
    """(k1, k2, rules): the indexed rules whose Boolean query the postings of a text satisfy.

    Postings are intersected as bit sets that merge map-side, so a key with
    many copies costs one row per task.
    """
    vocab = vocabulary(rules)
    at = {t: i for i, t in enumerate(vocab)}
    n = (len(vocab) + 61) // 62
    number = F.coalesce(*[F.when(F.col("trigram") == t, F.lit(i)) for t, i in at.items()], F.lit(-1))
    bits = index.select("k1", "k2", number.alias("_n")).filter("_n >= 0")
    one = F.lit(1).cast("long")
    masks = [F.bit_or(F.when(F.floor(F.col("_n") / 62) == w, F.call_function("shiftleft", one, (F.col("_n") % 62).cast("int"))).otherwise(0)).alias(f"_m{w}") for w in range(n)]

    def holds(query) -> Column:
        if isinstance(query, str):
            w, b = divmod(at[query], 62)
            return F.col(f"_m{w}").bitwiseAND(F.lit(1 << b)) != 0
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, map(holds, sorted(query[1], key=str)))

    named = [F.when(holds(q), F.lit(r.kind)) for r in rules if (q := trigram_query(r.regex)) is not True]
    met = bits.groupBy("k1", "k2").agg(*masks).select("k1", "k2", F.array_compact(F.array(*named)).alias("rules"))
    return met.filter(F.size("rules") > 0)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column, levels: int = 2) -> Column:
    """For each item of a non-empty array, the sum of the items before it.

    Sums of chunks of CHUNK items are summed up the same way and added to what
    runs inside a chunk, so the work is linear up to CHUNK**levels items and no
    array grows in an accumulator.
    """
    total = lambda items: F.aggregate(items, F.lit(0), lambda a, x: a + x)
    if levels == 0:
        return F.transform(sizes, lambda _, i: total(F.slice(sizes, 1, i)))

    def of_chunks(chunks: Column) -> Column:
        sums = bound(F.transform(chunks, total), lambda s: running(s, levels - 1))
        return F.flatten(F.zip_with(chunks, sums, lambda c, o: F.transform(c, lambda _, i: o + total(F.slice(c, 1, i)))))

    begins = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(CHUNK))
    return bound(F.transform(begins, lambda k: F.slice(sizes, k + 1, F.lit(CHUNK))), of_chunks)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) in code points: leftmost, non-overlapping matches of a rule.

    A split gives what lies between the matches, so running lengths give the
    positions. A match whose group is too short is dropped after matching, as
    it has used up its characters. Time is linear in the matches.
    """
    lengths = lambda items: F.transform(items, F.length)
    hits = lengths(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)))
    parts = lengths(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)))
    gaps = lengths(F.split(text, rule.regex, -1))
    found = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), parts.alias("part"))

    def span(x: Column, begin: Column) -> Column:
        start = (begin + x["gap"]).cast("int")
        return F.when(x["part"] >= rule.min_len, F.struct(start.alias("start"), F.lit(order).alias("o"), (start + x["hit"]).alias("end")))

    def placed(steps: Column) -> Column:
        sizes = F.transform(steps, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0)))
        return F.array_compact(F.zip_with(steps, bound(sizes, lambda s: running(s)), span))

    return bound(found, placed)


def scan_secrets(docs: DataFrame, rules=BASE_RULES + EXTRA_RULES, text: str = "text") -> DataFrame:
    """docs plus `secret_spans`: array of (start, o, end, kind), sorted by start, then rule order.

    Null and empty texts get an empty array; repeated rows stay repeated and
    get the same spans; other columns pass through, whatever their names, but
    a column called secret_spans gives way. The rows of one text are dealt to
    SALTS tasks by their other columns.
    """
    k1, k2 = text_key(F.col(text))
    index = build_index(docs, vocabulary(rules), text)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    found = candidates(index, rules).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("rules").alias("_rules"), salts)
    others = [docs[f.name] for f in docs.schema if f.name != text and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else F.lit(0)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[text].alias("_text"), salt.alias("_at"))
    k1, k2 = text_key(F.col("_text"))
    joined = keyed.join(found, (k1 == F.col("_k1")) & (k2 == F.col("_k2")) & (F.col("_at") == F.col("_salt")), "left")
    whole, none = F.coalesce("_text", F.lit("")), F.array().cast(SPANS)
    parts = []
    for o, r in enumerate(rules):
        maybe = whole.rlike(r.regex)
        if trigram_query(r.regex) is not True:
            maybe = F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)) & maybe
        parts.append(F.when(maybe, rule_spans(whole, r, o)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform("_spans", lambda s: s.withField("kind", F.element_at(kinds, s["o"] + 1)))
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).select(*unpacked(docs.drop("secret_spans")), spans.alias("secret_spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_rule(order: int):
    return lambda span: span["o"] == order


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans and all spans."""
    got = scan_secrets(docs.select("doc_id", "text"))
    spans, base = F.col("secret_spans"), len(BASE_RULES)
    only = F.filter(spans, lambda s: s["o"] < base)
    counts = [F.size(F.filter(spans, _of_rule(o))).cast("long").alias(f"n_{r.kind}") for o, r in enumerate(BASE_RULES)]
    return got.select("doc_id", *counts, F.sha2(written(only), 256).alias("base_sha256"), written(spans).alias("spans"))


def _kind_sql(o: int, r: Rule) -> str:
    regex = r.regex.replace("'", "''")
    return f"""select doc_id, {o} as o, '{r.kind}' as kind, unnest(string_split_regex(t, '{regex}')) as gap, unnest(regexp_extract_all(t, '{regex}', 0)) as hit,
    unnest(regexp_extract_all(t, '{regex}', {r.group})) as part, generate_subscripts(string_split_regex(t, '{regex}'), 1) as i from d"""


SECRETS_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(_kind_sql(o, r) for o, r in enumerate(BASE_RULES + EXTRA_RULES))}),
p as (select *, sum(length(gap) + coalesce(length(hit), 0)) over (partition by doc_id, o order by i)::bigint as e from m),
k as (select doc_id, o, kind, e - length(hit) as s, e from p join (values {", ".join(f"({o}, {r.min_len})" for o, r in enumerate(BASE_RULES + EXTRA_RULES))}) least_of(o, n) using (o) where hit is not null and length(part) >= n),
a as (select doc_id, count(*) filter (where o = 0) as n_assign, count(*) filter (where o = 1) as n_access, count(*) filter (where o = 2) as n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter (where o < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, o) as every from k group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans from d left join a using (doc_id)
"""
