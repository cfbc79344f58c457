"""Predicates and small expressions of the governance model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_evidence(evidence: Column) -> Column:
    """Evidence is null or holds white space only."""
    return F.coalesce(~evidence.rlike(r"\S"), F.lit(True))


def short_name(key: Column) -> Column:
    """What follows the first `::` of a tool key; the whole value without one."""
    return F.regexp_replace(key, r"^.*?::", "")


def is_resource_ref(ref: Column) -> Column:
    """A leading URI scheme that is not the start of a `server::tool` key."""
    return ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*::")


def sorted_set(column: Column) -> Column:
    """Aggregate: distinct non-null values in order, empty when there are none."""
    return F.coalesce(F.sort_array(F.collect_set(column)), F.array().cast("array<string>"))


def tool_key(server: Column, tool: Column) -> Column:
    """`server::tool`; null where a part is empty or holds `::` itself."""
    fine = (F.length(server) > 0) & (F.length(tool) > 0) & ~F.contains(server, F.lit("::")) & ~F.contains(tool, F.lit("::"))
    return F.when(fine, F.concat_ws("::", server, tool))
