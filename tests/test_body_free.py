"""The body-free check of control plans against a plain walk over parsed JSON."""

import json
from collections import Counter

import __spark_entry__ as entry
from palisade.plans import control


def nested(inner, levels):
    for _ in range(levels):
        inner = {"a": inner}
    return inner


def codes(spark, docs):
    df = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "run_id string, value string")
    out = {k: [] for k in docs}
    for r in control.body_findings(df).collect():
        out[r.run_id].append((r.code, r.subject))
    return {k: sorted(v) for k, v in out.items()}


def test_every_level_and_name(spark):
    docs = {
        "deep": nested({"password": 1, "at": "/etc/x"}, 9),
        "last": nested({"stdout": 1}, 99),
        "over": nested({"stdout": 1}, 100),
        "list": [[[["C:/x"]]]],
        "names": {"command": 1, "env": 1, "Headers": 1, "memory": 1, "model_selector": 1, "my_Token_2": 1, "prompt_text": 1},
        "key": {"https://u:pw@h/": "/etc"},
        "fine": {"content": "x", "messages": [1, None, True, "~/a"], "environment": "a"},
        "share": {"p": "\\\\host\\x"},
        "root": "\"token=abc\"",
        "broken": "{",
        "twice": '{"a": 1, "a": 2}',
        "far": "[" * 3000 + "]" * 3000,
    }
    assert codes(spark, docs) == {
        "deep": [("absolute_path", "at"), ("forbidden_field", "password")],
        "last": [("forbidden_field", "stdout")],
        "over": [("nesting", "100")],
        "list": [("absolute_path", "")],
        "names": sorted(("forbidden_field", k) for k in docs["names"]),
        "key": [("absolute_path", ""), ("credential_key", "")],
        "fine": [],
        "share": [("absolute_path", "p")],
        "root": [("credential_value", "")],
        "broken": [("not_json", "")],
        "twice": [("not_json", "")],
        "far": [("not_json", "")],
    }


def test_query_finds_every_name(spark, sf, monkeypatch):
    """Every conversation row is read; each barred name and part of a name that is taken out of the lists shows."""
    from palisade.late_queries import _BARRED, _NAMED

    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn").collect()
    put = Counter(_NAMED[(r.conv_id * 7 + r.turn) % len(_NAMED)] for r in rows)
    found = lambda: {r.subject: r.n for r in entry.queries()["c2_body_free_check"](spark, sf).collect() if r.code == "forbidden_field"}
    assert found() == {k: n for k, n in put.items() if k in _BARRED}
    monkeypatch.setattr(control, "BODY_FIELDS", tuple(c for c in control.BODY_FIELDS if c != "worktree"))
    assert "worktree" not in found()
    assert all(f"my_{c}_2" in _BARRED for c in control.BODY_PARTS) and set(control.BODY_FIELDS) <= set(_BARRED)


def test_names_put_into_rows_are_whole(spark):
    """The names that the query puts into rows are still the list its SQL was made of."""
    from palisade import late_queries

    assert isinstance(late_queries._NAMED, list) and repr(late_queries._NAMED) in entry.oracle_sql()["c2_body_free_check"]
