"""A manifest is parsed once for all its tables, and lists that are surely fine are told as a whole."""

import pytest
from palisade.operators import manifest
from palisade.sources import schema

GRANT = '{"agent":"a","tool":"s::t"%s}'
PROV = ',"provenance":{"source":%s,"confidence":"high"%s}'
ITEMS = [
    GRANT % "", GRANT % ',"granted_by":null', GRANT % (PROV % ('"crawled"', ',"evidence":null')), GRANT % (PROV % ('"crawled"', ',"evidence":"e"')), GRANT % ',"provenance":null',
    GRANT % (PROV % ('"rumour"', "")), GRANT % (PROV % ("null", "")), GRANT % (PROV % ("7", "")), GRANT % (PROV % ('"crawled"', ',"note":1')), GRANT % ',"provenance":{}', GRANT % ',"provenance":"x"',
    GRANT % ',"granted_by":"token=abc"', GRANT % ',"granted_by":7', GRANT % ',"agent: STRING, tool":"x"', '{"agent":"a"}', '{"agent":null,"tool":"t"}', '{"agent":"a","tool":true}', "null", "7", '"x"', "[]", "{}",
]


def documents():
    lists = ["", *ITEMS, *[f"{GRANT % ''},{i}" for i in ITEMS], *[f"{i},{ITEMS[3]}" for i in ITEMS]]
    return [f'{{"grants":[{x}]}}' for x in lists] + [f'{{"agents":[{x}]}}' for x in ("", '"a"', '"a",7', '"a",null', '"a","token=abc"', "null", "{}")] + ['{"grants":{}}', '{"agents":"a"}']


def test_lists_as_a_whole_tell_what_their_items_tell(spark, monkeypatch):
    docs = spark.createDataFrame([(d,) for d in documents()], "value string")
    told = lambda: {r.value: r.problem for r in schema.checked(docs, manifest.MANIFEST_RULE).select("value", "problem").collect()}
    whole = told()
    for rule in (schema.Text, schema.Fields):
        monkeypatch.setattr(rule, "typed", lambda self: None)
    assert whole == told()
    assert sum(p is None for p in whole.values()) >= 10 and len(set(whole.values())) >= 15


def test_a_manifest_is_parsed_once(spark):
    got, refused = manifest.read_manifests(spark.createDataFrame([("x", documents()[2]), ("y", "{")], "agent string, value string"))
    for name in ("agents", "policies", "grants", "data_access", "bindings", "exceptions"):
        assert "parse_json" not in getattr(got, name)._jdf.queryExecution().optimizedPlan().toString().lower(), name
    assert [tuple(r) for r in refused.select("agent", "value", "problem").collect()] == [("y", "{", "not JSON")]
    assert [(r.seq, r.agent, r.ref, r.granted_by) for r in got.grants.collect()] == [(0, "a", "s::t", None)]
    # A value stays as it was written only where it was refused.
    assert refused.columns == ["agent", "value", "problem"]


@pytest.mark.parametrize("name", ["grants", "data_access", "expected_exceptions", "agents", "policies"])
def test_long_lists_are_told_as_a_whole(name):
    assert manifest.MANIFEST_RULE.rules[name].of.typed()
