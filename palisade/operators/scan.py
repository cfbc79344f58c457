"""Scans along an order that no single task has to hold: numbers and previous rows of a key.

Rows are dealt to tasks by ranges of (key, order) and sorted there, so a key
with most of the rows lies in many tasks. What crosses a border between tasks
is one row a task: counts for the numbers, last rows for the previous ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.snapshots import cut

#: Bits of a row's place that count rows inside a task.
WITHIN = 33


def dealt(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows in tasks by ranges, with `_at`, ascending along (key, order), and `_task`.

    rows are stored first, as choosing the ranges reads them once more.
    """
    spread = cut(rows).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    return cut(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_at", WITHIN))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """rows plus each row's number in its key, from 1 along the order; rows equal in it go in any order."""
    held = dealt(rows, key, order)
    parts = held.groupBy(*key, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_begin"))
    # One row per key and task.
    earlier = F.sum("_n").over(Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_task").alias("_t"), (F.coalesce(earlier, F.lit(0)) - F.col("_begin") + 1).alias("_shift"))
    same = reduce(lambda a, b: a & b, [held[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(key)], held["_task"] == starts["_t"])
    return held.join(starts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def with_previous(rows: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows plus the value of the row before in the same key along the order, null where there is none.

    Places are unique, so the join with the row one place on is even however
    the keys are spread; a task's first row takes the last row of the task
    before it, of which there is one per task.
    """
    held = dealt(rows, key, order)
    whole = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(value).alias("v"))
    inside = held.select((F.col("_at") + 1).alias("_at"), whole.alias("_up"))
    lasts = held.groupBy("_task").agg(F.max_by(whole, "_at").alias("_last"))
    # One row per task.
    borders = lasts.select(F.shiftleft(F.col("_task"), WITHIN).alias("_at"), F.lag("_last").over(Window.orderBy("_task")).alias("_up"))
    got = held.join(inside.unionByName(borders.filter("_up is not null")), "_at", "left")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_up.k{i}")) for i, k in enumerate(key)], F.col("_up").isNotNull())
    return got.select(*rows.columns, F.when(same, F.col("_up.v")).alias(name))
