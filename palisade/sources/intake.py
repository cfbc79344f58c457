"""Reading exchanged JSON documents into tables; refused documents are returned beside them, with the place of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.predicates import tool_key
from palisade.operators.resolve import canonical_uri
from palisade.operators.scrub import is_credential_identity
from palisade.sources.model import HINTS, PROV
from palisade.sources.schema import Anything, Fields, Flag, Items, Mapping, Text, checked
from palisade.sources.snapshots import cut

TRANSPORTS = ("stdio", "streamable-http", "sse")


def _holds_delimiter(t: Column) -> Column:
    return F.contains(t, F.lit("::"))


NAME_CHECKS = ((_holds_delimiter, "must not hold '::'"), (is_credential_identity, "must not hold a credential"))
NAME = Text(1, checks=NAME_CHECKS)
_TOOL = Fields({"name": NAME, "description": Text(), "input_schema": Anything(), **{h: Flag() for h in HINTS}}, required=("name",), nullable=("description", "input_schema", *HINTS))
_RESOURCE = Fields({"uri": Text(1), "name": Text(), "mime_type": Text(), "description": Text()}, required=("uri",), nullable=("name", "mime_type", "description"))
#: A crawl: what one server says of itself. Further fields are ignored.
CRAWL_RULE = Fields(
    {"server_name": NAME, "server_version": Text(), "transport": Text(values=TRANSPORTS), "endpoint": Text(), "tools": Items(_TOOL), "resources": Items(_RESOURCE)},
    required=("server_name",), nullable=("server_version", "endpoint"),
)
CRAWL = (
    "struct<server_name:string,server_version:string,transport:string,endpoint:string,tools:array<struct<name:string,description:string,input_schema:variant,"
    + ",".join(f"{h}:boolean" for h in HINTS)
    + ">>,resources:array<struct<uri:string,name:string,mime_type:string,description:string>>>"
)
_SPEC = Fields(
    {
        "name": Text(checks=NAME_CHECKS), "transport": Text(values=TRANSPORTS), "command": Text(), "args": Items(Text()), "env": Mapping(Text()), "cwd": Text(pattern=r"\S"), "url": Text(), "headers": Mapping(Text()),
    },
    nullable=("name", "command", "cwd", "url"), closed=True,
    checks=((lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("cwd")), "$", "string").isNotNull(), F.lit(False)) & (F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("transport")), "$", "string"), F.lit("stdio")) != "stdio"), "has a cwd but no stdio transport"),),
)
#: A fleet: an empty list is a fleet of zero, a missing one is refused.
FLEET_RULE = Fields({"servers": Items(_SPEC)}, required=("servers",), closed=True)
SPEC = "struct<servers:array<struct<name:string,transport:string,command:string,url:string,cwd:string>>>"


def read_crawls(lines: DataFrame) -> dict[str, DataFrame]:
    """lines(value, crawl) -> servers, tools, resources, exposes, provides, refused.

    `crawl` orders the documents (0 where the column is missing). A document
    with one unusable element is refused whole, with the element's place in
    `problem`: a tool's name that is missing, null, or holds `::` would give a
    key of another tool or none. A tool's input_schema is kept as JSON text.
    """
    if "crawl" not in lines.columns:
        lines = lines.withColumn("crawl", F.lit(0))
    got = cut(checked(lines, CRAWL_RULE).drop("doc"))
    ok = got.filter("problem is null").select(F.col("crawl").cast("long").alias("crawl"), F.try_variant_get(F.try_parse_json("value"), "$", CRAWL).alias("c")).select("crawl", F.col("c.server_name").alias("server"), "c.*")
    ok = ok.withColumn("transport", F.coalesce("transport", F.lit("stdio")))
    prov = F.struct(F.lit("crawled").alias("source"), F.lit("high").alias("confidence"), F.concat(F.lit("crawled from "), F.coalesce("endpoint", "server")).alias("evidence")).cast(PROV)
    tools = ok.select("crawl", "server", "endpoint", F.posexplode("tools").alias("seq", "t")).select("crawl", "server", "endpoint", F.col("seq").cast("long").alias("seq"), "t.*").withColumn("key", tool_key(F.col("server"), F.col("name")))
    said = F.when(F.schema_of_variant("input_schema") == "STRING", F.try_variant_get("input_schema", "$", "string")).when(~F.is_variant_null("input_schema"), F.to_json("input_schema"))
    tools = tools.withColumn("input_schema", said)
    resources = ok.select("crawl", "server", "endpoint", F.posexplode("resources").alias("seq", "r")).select("crawl", "server", "endpoint", F.col("seq").cast("long").alias("seq"), "r.*").withColumn("uri", canonical_uri(F.col("uri")))
    return {
        "servers": ok.select(F.col("server").alias("name"), F.col("server_version").alias("version"), "transport", "endpoint", "crawl"),
        "tools": tools.select("key", "name", "server", "description", "input_schema", *HINTS, "crawl", "seq"),
        "resources": resources.select("server", "uri", "name", "mime_type", "description", "crawl", "seq"),
        "exposes": tools.select("server", F.col("key").alias("tool_key"), prov.alias("prov")).dropDuplicates(["server", "tool_key"]),
        "provides": resources.select("server", "uri", prov.alias("prov")).dropDuplicates(["server", "uri"]),
        "refused": got.filter("problem is not null"),
    }


def read_fleets(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(value, ...) of fleet files -> (specs, refused): names that can't form a key, a blank cwd and one without stdio, unknown fields and a missing list are refused with their place."""
    got = cut(checked(lines, FLEET_RULE).drop("doc"))
    specs = got.filter("problem is null").select(F.inline(F.try_variant_get(F.try_parse_json("value"), "$", SPEC)["servers"])).withColumn("transport", F.coalesce("transport", F.lit("stdio")))
    return specs, got.filter("problem is not null")
