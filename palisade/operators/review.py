"""Human review of candidates: reports, events, dispositions and the plan that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import selector
from palisade.operators.scan import numbered, with_previous
from palisade.operators.scrub import is_credential_identity, is_credential_shaped
from palisade.sources.model import Graph
from palisade.sources.schema import Fields, Items, Text, Whole, checked, repeats, spread
from palisade.sources.snapshots import cut

FIELDS = ["run_id", "pattern_id", "pattern_version", "tool_key", "artifact_digest"]
DISPOSITIONS = ("open", "accepted", "rejected", "deferred")
#: Lengths and forms. Fixed values of the review contract.
MOST_REVIEWER, MOST_NOTE = 256, 500
MOST_BYTES = 50_000_000
DIGEST = r"^sha256:[0-9a-f]{64}\z"
UTC_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]00:00)\z"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"

_IDENTITY = (is_credential_identity, "must not hold a credential")
_CANDIDATE = {
    "run_id": Text(1, 256, r"^\S+\z", checks=(_IDENTITY,)), "pattern_id": Text(pattern=r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"), "pattern_version": Whole(1, written=True),
    "tool_key": Text(4, 512, r"^\S+::\S+\z", checks=(_IDENTITY,)), "artifact_digest": Text(pattern=DIGEST),
}
#: One clean line: what reviewers and notes have to be.
_LINE = (
    (lambda t: t.rlike(r"[\r\n\x00]"), "must be one line"),
    (lambda t: t.rlike(r"(?U)^\s|\s\z"), "begins or ends with white space"),
    (is_credential_shaped, "must not hold a credential"),
)


def _identities(items: Column) -> Column:
    return F.transform(items, lambda x: F.to_json(F.struct(*[F.try_variant_get(x, f"$.{f}", "string").alias(f) for f in FIELDS])))


#: A report of candidates; further fields are ignored, those of a candidate beyond its five too.
REPORT_RULE = Fields(
    {"schema_version": Whole(values=(1,), written=True), "kind": Text(pattern=r"^[^\s.]+\.review-candidates\z"), "candidates": Items(Fields(_CANDIDATE, required=tuple(FIELDS)), checks=((lambda xs: repeats(_identities(xs)), "names a candidate twice"),))},
    required=("schema_version", "kind", "candidates"),
)
_EVENT = Fields(
    {
        "sequence": Whole(1, written=True), "candidate_id": Text(pattern=UUID), "candidate": Fields(_CANDIDATE, required=tuple(FIELDS), closed=True), "from_disposition": Text(values=DISPOSITIONS), "disposition": Text(values=DISPOSITIONS),
        "reviewer": Text(1, MOST_REVIEWER, checks=_LINE), "recorded_at": Text(pattern=UTC_INSTANT, checks=((lambda t: F.try_to_timestamp(t).isNull(), "is no instant"),)), "note": Text(1, MOST_NOTE, checks=_LINE),
    },
    required=("sequence", "candidate_id", "candidate", "from_disposition", "disposition", "reviewer", "recorded_at"), nullable=("note",), closed=True,
)
_SOURCE = Fields({"schema_version": Whole(values=(1,), written=True), "kind": REPORT_RULE.rules["kind"], "source_report_digest": Text(pattern=DIGEST)}, required=("schema_version", "kind", "source_report_digest"), closed=True)
#: What reviewers said of one report. No further fields.
ANNOTATION_RULE = Fields(
    {"schema_version": Whole(values=(1,), written=True), "kind": Text(pattern=r"^[^\s.]+\.review-annotations\z"), "source": _SOURCE, "events": Items(_EVENT)},
    required=("schema_version", "kind", "source", "events"), closed=True,
)
_CANDIDATE_ROW = "run_id:string,pattern_id:string,pattern_version:bigint,tool_key:string,artifact_digest:string"
_EVENTS = f"array<struct<sequence:bigint,candidate_id:string,candidate:struct<{_CANDIDATE_ROW}>,from_disposition:string,disposition:string,reviewer:string,recorded_at:string,note:string>>"


def _documents(files: DataFrame, rule: Fields) -> DataFrame:
    """files plus value, problem and `_digest` of the bytes; what is no UTF-8 is no JSON either."""
    named = files.withColumns({"value": F.try_validate_utf8(F.col("content").cast("string")), "_digest": F.sha2("content", 256)})
    return cut(checked(spread(named), rule, MOST_BYTES).drop("doc", "content"))


def read_reports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(content, ...) -> (candidates with the report's digest, refused files).

    Five fields of a candidate are kept. A report with one badly typed
    candidate, or with a candidate twice, is refused whole with the place in
    `problem`; a file that is there several times counts once. Refused rows
    have files' columns but content, and `report`, `value` and `problem`.
    """
    got = _documents(files, REPORT_RULE)
    fine = got.filter("problem is null").dropDuplicates(["_digest"]).select(F.col("_digest").alias("report"), F.explode(F.try_variant_get(F.try_parse_json("value"), "$.candidates", f"array<struct<{_CANDIDATE_ROW}>>")).alias("c"))
    return fine.select("report", "c.*"), got.filter("problem is not null").drop("report").withColumnRenamed("_digest", "report")


def read_annotations(files: DataFrame, reports: DataFrame, identify: Column) -> tuple[DataFrame, DataFrame]:
    """files(content, ...) of annotations -> (events with the fields of their candidates, refused files with `problem`).

    reports(report): digests that annotations may name; identify: the id of a
    candidate from its five columns (see candidate_id). A file is refused whole
    if a field is not as ANNOTATION_RULE says, its report is unknown, or an
    event's id is not that of the candidate beside it. Sequence and chain are
    checked by sequence_gaps and chain_breaks, over all events of a report.
    """
    got = _documents(files, ANNOTATION_RULE)
    doc = F.try_parse_json("value")
    # Taken out below the explode: what stands beside it is computed once for every row that it makes.
    parts = got.filter("problem is null").dropDuplicates(["_digest"]).select("_digest", F.substring(F.try_variant_get(doc, "$.source.source_report_digest", "string"), 8, 64).alias("report"), F.try_variant_get(doc, "$.events", _EVENTS).alias("_events"))
    fine = parts.select("_digest", "report", F.posexplode_outer("_events").alias("_pos", "e"))
    events = fine.select("_digest", "_pos", "report", F.col("e.candidate_id").alias("candidate"), F.col("e.sequence").alias("seq"), "e.candidate.*", "e.from_disposition", "e.disposition", "e.reviewer", "e.recorded_at", "e.note")
    known = reports.select("report").distinct().withColumn("_known", F.lit(True))
    foreign = F.when(~F.col("candidate").eqNullSafe(identify) & F.col("candidate").isNotNull(), F.col("_pos"))
    odd = events.join(known, "report", "left").groupBy("_digest").agg(F.bool_or(F.col("_known").isNull()).alias("_u"), F.min(foreign).alias("_p"))
    why = F.when(F.col("_u"), "names an unknown report").when(F.col("_p").isNotNull(), F.concat(F.lit("events."), F.col("_p").cast("string"), F.lit(".candidate_id: is another candidate's")))
    odd = cut(odd.select("_digest", why.alias("_why")).filter("_why is not null"))
    refused = got.join(odd, "_digest", "left").withColumn("problem", F.coalesce("problem", "_why")).filter("problem is not null").drop("_why", "_digest")
    return events.filter("candidate is not null").join(odd, "_digest", "left_anti").drop("_digest", "_pos"), refused


def read_events(events: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of a known report, refused events)."""
    known = reports.select("report").distinct()
    return events.join(known, "report", "left_semi"), events.join(known, "report", "left_anti")


def candidate_id(namespace: str, version: int, kind: str) -> Column:
    """UUIDv5 of the JSON list of schema version, kind and the five identity fields."""
    quoted = lambda c: F.to_json(F.array(F.col(c)))
    parts = [F.regexp_replace(quoted(c), r"^\[|\]$", "") if c != "pattern_version" else F.col(c).cast("string") for c in FIELDS]
    name = F.concat(F.lit(f'[{version},"{kind}",'), F.concat_ws(",", *parts), F.lit("]"))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(report, seq): events out of the sequence 1..n of their report, however long that is."""
    return numbered(events.select("report", "seq"), ["report"], ["seq"], "_n").filter(F.col("seq") != F.col("_n")).select("report", "seq")


def chain_breaks(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """(report, seq, problem): unknown candidates, and events whose from_disposition is not the one before (first: open)."""
    slim = events.select("report", "candidate", "seq", "disposition", "from_disposition")
    known = candidates.select("report", "candidate", F.lit(True).alias("_k")).distinct()
    got = with_previous(slim, ["report", "candidate"], ["seq"], "disposition", "_before").join(known, ["report", "candidate"], "left")
    problem = F.when(F.col("_k").isNull(), "unknown candidate").when(~F.col("from_disposition").eqNullSafe(F.coalesce("_before", F.lit("open"))), "broken chain")
    return got.select("report", "seq", problem.alias("problem")).filter("problem is not null")


def current_dispositions(candidates: DataFrame, events: DataFrame, status: str | None = None) -> DataFrame:
    """candidates plus disposition (default open), number of events and their history."""
    last = events.groupBy("report", "candidate").agg(F.max_by("disposition", "seq").alias("_d"), F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct("seq", "disposition", "reviewer"))).alias("history"))
    got = candidates.join(last, ["report", "candidate"], "left").withColumns({"disposition": F.coalesce("_d", F.lit("open")), "events": F.coalesce("events", F.lit(0))}).drop("_d")
    return got if status is None else got.filter(F.col("disposition") == status)


def append_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """new(report, candidate, disposition, at, ...) with the next sequence numbers and current from_disposition."""
    most = old.groupBy("report").agg(F.max("seq").alias("_m"))
    last = old.groupBy("report", "candidate").agg(F.max_by("disposition", "seq").alias("_d"))
    placed = with_previous(new, ["report", "candidate"], ["at"], "disposition", "_before")
    placed = numbered(placed, ["report"], ["at", "candidate"], "_n")
    got = placed.join(most, "report", "left").join(last, ["report", "candidate"], "left")
    seq = F.coalesce("_m", F.lit(0)) + F.col("_n")
    return got.select(*new.columns, seq.alias("seq"), F.coalesce("_before", "_d", F.lit("open")).alias("from_disposition"))


def field_problems(events: DataFrame) -> DataFrame:
    """(report, seq, field) of reviewers and notes that are not single clean lines, instants that are not of UTC, and bad digests."""
    line = lambda c, most: F.col(c).isNotNull() & (F.col(c).rlike(r"[\r\n\x00]") | (F.trim(c) == "") | (F.length(c) > most) | is_credential_shaped(F.col(c)))
    fits = lambda c, form: F.coalesce(F.col(c).rlike(form), F.lit(False))
    bad = [
        F.when(F.col("reviewer").isNull() | line("reviewer", MOST_REVIEWER), "reviewer"), F.when(line("note", MOST_NOTE), "note"), F.when(~fits("report", "^[0-9a-f]{64}\\z"), "report"),
        F.when(~fits("recorded_at", UTC_INSTANT) | F.try_to_timestamp("recorded_at").isNull(), "recorded_at"),
    ]
    return events.select("report", "seq", F.explode(F.array_compact(F.array(*bad))).alias("field"))


def review_plan(candidates: DataFrame, events: DataFrame, graph: Graph, agents: DataFrame, profile: str = "strict") -> DataFrame:
    """Accepted candidates with the current decision for an agent; the action is fixed and nothing changes by itself."""
    accepted = current_dispositions(candidates, events, "accepted").join(agents, "report")
    asked = accepted.select("agent", F.lit(1).alias("pos"), F.col("tool_key").alias("ref")).distinct()
    now = selector.eligible_tools(graph, asked, profile, evidence=False).select("agent", F.col("candidate").alias("tool_key"), F.when(F.col("reason").isNull(), "eligible").otherwise("rejected").alias("decision"), "reason")
    got = accepted.join(now, ["agent", "tool_key"], "left")
    return got.select("report", "candidate", "agent", "tool_key", F.coalesce("decision", F.lit("unresolved")).alias("decision"), "reason", F.lit("review_policy").alias("action"), F.lit(False).alias("automatic"))
