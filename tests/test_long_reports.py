"""Scans of one report that holds all events, against windows over the whole report."""

import pytest
from palisade.operators import review, scan
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small ranges stay apart, so that scans cross borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def events(spark, n, reports=1):
    e = spark.range(n, numPartitions=6).withColumn("report", F.format_string("r%d", F.col("id") % reports)).withColumn("candidate", F.format_string("c%d", F.xxhash64("id") % 50))
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("report").orderBy(F.xxhash64("id"))))
    return e.withColumn("disposition", F.element_at(F.array(*map(F.lit, ("open", "accepted", "deferred"))), (F.col("id") % 3 + 1).cast("int"))).withColumn("from_disposition", F.lit("open")).drop("id")


def test_scans_equal_windows(spark):
    for reports in (1, 40):
        e = events(spark, 4000, reports)
        before = F.lag("disposition").over(Window.partitionBy("report", "candidate").orderBy("seq"))
        want = {(r.report, r.seq): r.b for r in e.withColumn("b", before).collect()}
        got = {(r.report, r.seq): r.b for r in scan.with_previous(e, ["report", "candidate"], ["seq"], "disposition", "b").collect()}
        assert got == want
        odd = e.withColumn("seq", F.col("seq") * 3)
        assert all(3 * r.n == r.seq for r in scan.numbered(odd, ["report"], ["seq"], "n").collect())


def test_one_report_is_dealt_to_all_tasks(spark):
    sizes = [r["count"] for r in scan.dealt(events(spark, 8000), ["report"], ["seq"]).groupBy("_task").count().collect()]
    sizes.sort()
    assert len(sizes) > 1 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_null_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("r", 1, "c")], "report string, seq long, disposition string")
    got = sorted((str(r.report), r.seq, r.b) for r in scan.with_previous(rows, ["report"], ["seq"], "disposition", "b").collect())
    assert got == [("None", 1, None), ("None", 2, "a"), ("r", 1, None)]
    assert scan.with_previous(rows.limit(0), ["report"], ["seq"], "disposition", "b").count() == 0 and scan.numbered(rows.limit(0), ["report"], ["seq"], "n").count() == 0
    assert sorted(r.n for r in scan.numbered(rows, ["report"], ["seq"], "n").collect()) == [1, 1, 2]


def test_append_goes_on_from_the_last_event(spark):
    old = spark.createDataFrame([("r", "a", 1, "accepted"), ("r", "b", 2, "deferred")], "report string, candidate string, seq long, disposition string")
    new = spark.createDataFrame([("r", "a", "rejected", 5), ("r", "a", "open", 6), ("r", "c", "accepted", 4), ("q", "a", "accepted", 1)], "report string, candidate string, disposition string, at long")
    got = sorted((r.report, r.seq, r.candidate, r.from_disposition) for r in review.append_events(old, new).collect())
    assert got == [("q", 1, "a", "open"), ("r", 3, "c", "open"), ("r", 4, "a", "accepted"), ("r", 5, "a", "rejected")]
