"""Artifacts: one canonical JSON document per row, its SHA-256, and a time of creation with its offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = "kind string, created_at string, body string, digest string"
#: A time stamp with an offset in whole minutes. Fixed values of the exchange contract.
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?"
_OFFSET = r"(?:Z|[+-]\d{2}:\d{2})$"


def canonical_json(value: Column) -> Column:
    """JSON with sorted names at every level, nulls kept, no spaces, and a line end."""
    return F.concat(F.to_json(F.parse_json(F.to_json(value, {"ignoreNullFields": "false"}))), F.lit("\n"))


def digest_of(body: Column) -> Column:
    """`sha256:` and the hex digest of a body's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def created_at_problem(created_at: Column) -> Column:
    """Why a time can't be stamped on an artifact, null if it can."""
    return (
        F.when(~F.coalesce(created_at.rlike(_TIME), F.lit(False)), "created_at is not a time stamp")
        .when(created_at.rlike(_TIME + "$"), "created_at has no offset")
        .when(~created_at.rlike(_TIME + _OFFSET), "created_at's offset is not in whole minutes")
    )


def artifacts(rows: DataFrame, kind: str, value: Column, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """(artifacts, refused rows with `problem`): created_at becomes part of the document."""
    marked = rows.withColumn("problem", created_at_problem(created_at))
    body = canonical_json(F.struct(F.lit(kind).alias("kind"), created_at.alias("created_at"), value.alias("value")))
    made = marked.filter("problem is null").select(F.lit(kind).alias("kind"), created_at.alias("created_at"), body.alias("body"))
    return made.withColumn("digest", digest_of(F.col("body"))), marked.filter("problem is not null")


def write_artifacts(made: DataFrame, path: str) -> None:
    """Append artifacts to a table; a failed job leaves nothing that is read."""
    made.select("kind", "created_at", "body", "digest").write.mode("append").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts under path, with `intact`: whether the body still has its digest."""
    return spark.read.schema(ARTIFACT).parquet(path).withColumn("intact", digest_of(F.col("body")) == F.col("digest"))
