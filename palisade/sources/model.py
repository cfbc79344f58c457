"""The governance graph as named tables, and their schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PROV = T.StructType().add("source", "string").add("confidence", "string").add("evidence", "string")
HINTS = ("read_only_hint", "destructive_hint", "idempotent_hint", "open_world_hint")


def _table(*columns: str) -> T.StructType:
    out = T.StructType()
    for c in columns:
        name, _, kind = c.partition(" ")
        out.add(name, PROV if kind == "prov" else kind or "string")
    return out


#: One table per node label and edge type.
SCHEMAS = {
    "servers": _table("name", "version", "transport", "endpoint", "last_crawled_at timestamp"),
    "tools": _table("key", "name", "server", "description", "input_schema", *[f"{h} boolean" for h in HINTS]),
    "resources": _table("uri", "name", "mime_type", "description"),
    "agents": _table("id"),
    "policies": _table("id", "effect", "scope", "description"),
    "exceptions": _table("agent", "tool_key", "resource", "policy", "reason"),
    "exposes": _table("server", "tool_key", "prov prov"),
    "provides": _table("server", "uri", "prov prov"),
    "can_call": _table("agent", "tool_key", "granted_by", "prov prov"),
    "data_access": _table("tool_key", "mode", "uri", "prov prov"),
    "governed_resource": _table("uri", "policy", "prov prov"),
    "governed_tool": _table("tool_key", "policy", "prov prov"),
}
KEYS = {
    "servers": ["name"],
    "tools": ["key"],
    "resources": ["uri"],
    "agents": ["id"],
    "policies": ["id"],
    "exceptions": ["agent", "tool_key", "resource", "policy"],
    "exposes": ["server", "tool_key"],
    "provides": ["server", "uri"],
    "can_call": ["agent", "tool_key"],
    "data_access": ["tool_key", "mode", "uri"],
    "governed_resource": ["uri", "policy"],
    "governed_tool": ["tool_key", "policy"],
}
#: Tables that a crawl owns; the others are authored.
CRAWLED = ("servers", "tools", "resources", "exposes", "provides")
AUTHORED = ("agents", "policies", "exceptions", "can_call", "data_access", "governed_resource", "governed_tool")


@dataclass(frozen=True)
class Graph:
    """One DataFrame per table of SCHEMAS."""

    servers: DataFrame
    tools: DataFrame
    resources: DataFrame
    agents: DataFrame
    policies: DataFrame
    exceptions: DataFrame
    exposes: DataFrame
    provides: DataFrame
    can_call: DataFrame
    data_access: DataFrame
    governed_resource: DataFrame
    governed_tool: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def graph_of(spark: SparkSession, **rows) -> Graph:
    """A graph from DataFrames or lists of dicts; tables that are not named are empty."""
    made = {}
    for name, schema in SCHEMAS.items():
        given = rows.get(name, [])
        made[name] = given if isinstance(given, DataFrame) else spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in given], schema)
    return Graph(**made)


def duplicate_keys(graph: Graph) -> DataFrame:
    """(table, key, n) of keys that occur more than once."""
    from functools import reduce

    from pyspark.sql import functions as F

    parts = []
    for name, keys in KEYS.items():
        key = F.to_json(F.array(*[F.col(k) for k in keys]))
        parts.append(getattr(graph, name).groupBy(key.alias("key")).count().filter("count > 1").select(F.lit(name).alias("table"), "key", F.col("count").alias("n")))
    return reduce(DataFrame.unionByName, parts)
