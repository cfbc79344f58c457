"""Typed intake of reports and annotations: what each file is refused for."""

import json

import pytest
from pyspark.sql import functions as F
from palisade.operators import review
from palisade.sources import schema

SPACE, KIND = "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "made.review-candidates"
FINE = {"run_id": "r", "pattern_id": "a-b", "pattern_version": 1, "tool_key": "s::t", "artifact_digest": "sha256:" + "0" * 64}


def files(spark, docs):
    return spark.createDataFrame([(i, bytearray(d if isinstance(d, bytes) else json.dumps(d).encode())) for i, d in enumerate(docs)], "at long, content binary")


def report(*candidates, **change):
    return {"schema_version": 1, "kind": KIND, "candidates": list(candidates)} | change


def told(refused):
    return {r["at"]: r.problem for r in refused.collect()}


def test_reports(spark):
    docs = [
        report(FINE, FINE | {"run_id": "q", "extra": 1}, further=2), report(FINE | {"pattern_version": 1.0}), report(FINE, FINE | {"run_id": None}), report(FINE, FINE | {"note": "differs"}), report(FINE | {"tool_key": "token=abc::t"}),
        report(FINE | {"pattern_version": 10**20}), report(FINE | {"artifact_digest": "0" * 64}), report(schema_version=2), report(FINE | {"pattern_id": "A"}), b"\xff{}", b'{"kind": 1, "kind": 2}', b"", report(), report(FINE | {"run_id": "a b"}),
    ]
    got, refused = review.read_reports(files(spark, [*docs, docs[0]]))
    assert sorted((r.run_id, r.pattern_version) for r in got.collect()) == [("q", 1), ("r", 1)]
    assert told(refused) == {
        1: "candidates.0.pattern_version: must be an integer", 2: "candidates.1.run_id: must not be null", 3: "candidates: names a candidate twice", 4: "candidates.0.tool_key: must not hold a credential", 5: "candidates.0.pattern_version: must be an integer",
        6: "candidates.0.artifact_digest: has another form", 7: "schema_version: must be one of the known values", 8: "candidates.0.pattern_id: has another form", 9: "not JSON", 10: "not JSON", 11: "not JSON", 13: "candidates.0.run_id: has another form",
    }


@pytest.fixture(scope="module")
def named(spark):
    rows = spark.createDataFrame([tuple(FINE.values()), tuple((FINE | {"run_id": "q"}).values())], "run_id string, pattern_id string, pattern_version long, tool_key string, artifact_digest string")
    return {r.run_id: r.id for r in rows.select("run_id", review.candidate_id(SPACE, 1, KIND).alias("id")).collect()}


def test_annotations(spark, named):
    event = {"sequence": 1, "candidate_id": named["r"], "candidate": FINE, "from_disposition": "open", "disposition": "accepted", "reviewer": "ann", "recorded_at": "2026-01-01T00:00:00Z", "note": None}
    later = event | {"sequence": 2, "candidate_id": named["q"], "candidate": FINE | {"run_id": "q"}, "recorded_at": "2026-01-01T00:00:00.25+00:00", "note": "fine"}
    known = "a" * 64

    def side(*events, digest=known, **change):
        return {"schema_version": 1, "kind": "made.review-annotations", "source": {"schema_version": 1, "kind": KIND, "source_report_digest": f"sha256:{digest}"}, "events": list(events)} | change

    bad = {
        "events.1.candidate_id: is another candidate's": side(event, later | {"candidate_id": named["r"]}), "names an unknown report": side(digest="b" * 64), "has an unknown field": side(note=1), "events.0.candidate: has an unknown field": side(event | {"candidate": FINE | {"x": 1}}),
        "events.0.sequence: must be at least 1": side(event | {"sequence": 0}), "events.0.candidate_id: has another form": side(event | {"candidate_id": named["r"].upper()}), "events.0.disposition: must be one of the known values": side(event | {"disposition": "Open"}),
        "events.0.reviewer: must be one line": side(event | {"reviewer": "a\nb"}), "events.0.reviewer: begins or ends with white space": side(event | {"reviewer": " a"}), "events.0.reviewer: has a length out of bounds": side(event | {"reviewer": "a" * 257}), "events.0.reviewer: must not be null": side(event | {"reviewer": None}),
        "events.0.note: must not hold a credential": side(event | {"note": "token: rotated"}), "events.0.note: has a length out of bounds": side(event | {"note": "n" * 501}), "events.0.recorded_at: has another form": side(event | {"recorded_at": "2026-01-01T00:00:00"}), "events.0.recorded_at: is no instant": side(event | {"recorded_at": "2026-02-30T00:00:00Z"}),
    }
    reports = spark.createDataFrame([(known,), (known,)], "report string")
    got, refused = review.read_annotations(files(spark, [side(event, later), side(), *bad.values()]), reports, review.candidate_id(SPACE, 1, KIND))
    assert sorted((r.report, r.seq, r.run_id, r.candidate, r.note) for r in got.collect()) == [(known, 1, "r", named["r"], None), (known, 2, "q", named["q"], "fine")]
    assert told(refused) == dict(enumerate(bad, 2))


def test_no_files(spark):
    got, refused = review.read_reports(files(spark, [report()]).limit(0))
    assert got.count() == refused.count() == 0
    got, refused = review.read_annotations(files(spark, [report()]).limit(0), spark.createDataFrame([], "report string"), review.candidate_id(SPACE, 1, KIND))
    assert got.count() == refused.count() == 0


def test_integers_fit_into_64_bits(spark):
    rule = schema.Fields({"n": schema.Whole(1)})
    docs = [{"n": 2**63 - 1}, {"n": 2**63}, {"n": 10**30}, {"n": 1e300}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "at long, value string")
    assert {r["at"]: r.problem for r in schema.checked(rows, rule).collect()} == {0: None, 1: "n: is out of bounds", 2: "n: is out of bounds", 3: "n: is out of bounds"}


def test_fields_of_events(spark):
    sha, at = "a" * 64, "2026-01-01T00:00:00Z"
    rows = [(sha, 1, "ann", None, at), (sha, 2, " ", "", at), (sha, 3, None, "n" * 501, None), (sha + "\n", 4, "a" * 256, "n" * 500, "2026-01-01T00:00:00+01:00"), (None, 5, "a" * 257, "a\x00b", "2026-01-01T25:00:00Z"), ("A" * 64, 6, "password=x", "secret: x", at + "\n")]
    got = review.field_problems(spark.createDataFrame(rows, "report string, seq long, reviewer string, note string, recorded_at string"))
    both = ["note", "reviewer"]
    assert {(r.seq, r.field) for r in got.collect()} == {(i, f) for i, fs in {2: both, 3: [*both, "recorded_at"], 4: ["report", "recorded_at"], 5: [*both, "report", "recorded_at"], 6: [*both, "report", "recorded_at"]}.items() for f in fs}


def test_annotations_are_parsed_once_for_all_their_events(spark):
    """Nothing above the explode of a document's events parses the document again, which would cost the square of its length."""
    files = spark.createDataFrame([(bytearray(b"{}"),)], "content binary")
    events, _ = review.read_annotations(files, spark.createDataFrame([], "report string"), F.lit("x"))
    above, _, below = events._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert below and "parse_json" not in above.lower() and "parsejson" not in above.lower()


def test_checks_are_spread_over_all_cores(spark):
    assert schema.spread(spark.range(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
