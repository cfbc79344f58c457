"""Further columns that are called like working ones, many sources, and ties of language identification."""

import math

import pytest
from palisade.llm import langid, lm, mixing, neardup
from test_native import water_fill


def test_further_columns_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    odd = docs.selectExpr("doc_id", "text", "'b' as block", "1 as shard", "'t' as train", "'n' as node", "'l' as label", "0.5 as score", "array(1) as words", "2 as k1", "true as held_out")
    for f in (lm.score_documents, neardup.near_duplicates):
        want = sorted(tuple(r) for r in f(docs.select("doc_id", "text")).collect())
        assert sorted(tuple(r) for r in f(odd).collect()) == want


@pytest.mark.parametrize("many", [False, True])
def test_targets_of_many_sources(spark, many):
    n = 3000 if many else 7
    sizes = {(f"s{i:05}" if i else None): (i * 37) % 101 * (50 if i % 9 == 0 else 1) for i in range(n)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    assert mixing.source_targets(frame.limit(0)).count() == 0


def test_equal_languages_tie_by_name(spark):
    """Two languages learned from the same texts: the first by name is named, without a margin."""
    text = "the same words stand in both of these languages, so nothing tells them apart"
    rows = [(i, f"{text} {i % 5}", "bb" if i % 2 else "aa") for i in range(60)]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} <= {"aa", "bb"} and all(0 <= r.score <= 1 for r in got)
    again = langid.identify_languages(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == sorted((r.doc_id, r.lang_pred) for r in again)
