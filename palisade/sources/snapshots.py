"""Versioned graph tables: a generation is written whole, then one entry of a log publishes it.

Entries are numbered by their place in the lineage and name their parent. An
entry is created only where none of its number exists, so of two publishers
that start from one state one wins, and the other goes on top of it. Clocks
decide nothing, and no folder of an earlier generation is ever written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.model import SCHEMAS, Graph, graph_of

STATE = "instance_id string, generation long, governance_digest string"
#: Times that a publisher goes on top of another before it gives up.
MOST_TRIES = 50


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share; a local one only where Spark itself runs on one machine."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(path or f"file:///tmp/spark-checkpoints-{uuid.uuid4().hex[:8]}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, as a new start of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, of which later reads take the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Entry:
    """One publication: its number, its parent's (0: none), and the folder of its tables."""

    number: int
    parent: int
    instance_id: str
    generation: int
    governance_digest: str | None
    updated_at: str
    tables: str


class StaleState(RuntimeError):
    """What a graph was derived from is no longer the current state."""


def _files(spark: SparkSession, path: str):
    """(Hadoop's file context of a path, a maker of paths)."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    whole = make(path)
    uri = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(whole).toUri()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration()), make


def head(spark: SparkSession, root: str) -> Entry | None:
    """The last entry of the log; entries are read by number, and names that are none are passed over."""
    files, path = _files(spark, root)
    log = path(f"{root}/log")
    if not files.util().exists(log):
        return None
    listed, last = files.listStatus(log), 0
    while listed.hasNext():
        name = listed.next().getPath().getName()
        last = max(last, int(name.removesuffix(".json")) if name.endswith(".json") and name[:-5].isdigit() else 0)
    return Entry(**json.loads(spark.read.text(f"{root}/log/{last:020d}.json").first().value)) if last else None


def commit(spark: SparkSession, root: str, entry: Entry) -> bool:
    """Create the entry's file under its number; False where another publisher has taken the number.

    The text is written aside and moved: a reader sees a whole entry or none.
    """
    files, path = _files(spark, root)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    aside, place = path(f"{root}/log/_{uuid.uuid4().hex}"), path(f"{root}/log/{entry.number:020d}.json")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts").createParent()
    out = files.create(aside, flags, options)
    out.write(bytearray(json.dumps(asdict(entry)).encode()))
    out.close()
    never = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    never[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        files.rename(aside, place, never)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        files.delete(aside, False)
        return False
    return True


def graph_state(spark: SparkSession, root: str) -> DataFrame:
    """The current (instance_id, generation, governance_digest): the log's last entry; 0 and null where nothing was published."""
    e = head(spark, root)
    return spark.createDataFrame([(e.instance_id, e.generation, e.governance_digest) if e else (None, 0, None)], STATE)


def publish(graph: Graph, root: str, digest: str | None = None, instance_id: str | None = None, based_on: int | None = None) -> int:
    """Write all tables to a folder of their own, then append an entry on top of the log; its generation.

    Without a digest the current one stays; a new instance_id begins at
    generation 0 without one. based_on: the number of the entry that the graph
    was derived from (0: none); if another entry is current by then, nothing
    is published and StaleState is raised. A job that fails before its entry
    stands leaves a folder nobody reads.
    """
    spark = graph.tools.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in graph.tables().items():
        df.write.parquet(f"{folder}/{name}")
    for _ in range(MOST_TRIES):
        last = head(spark, root)
        number = last.number if last else 0
        if based_on is not None and based_on != number:
            raise StaleState(f"entry {number} is current, not {based_on}")
        instance = instance_id or (last.instance_id if last else uuid.uuid4().hex)
        generation = 0 if instance_id else (last.generation if last else 0) + 1
        kept = digest if digest is not None or instance_id else last.governance_digest if last else None
        if commit(spark, root, Entry(number + 1, number, instance, generation, kept, datetime.now(UTC).isoformat(), folder)):
            return generation
    raise StaleState(f"{MOST_TRIES} other publishers came first")


def reset(spark: SparkSession, root: str) -> None:
    """Publish empty tables under a new instance id, generation 0, without a digest."""
    publish(graph_of(spark), root, instance_id=uuid.uuid4().hex)


def read(spark: SparkSession, root: str, at: Entry | None = None) -> Graph:
    """The tables of the current entry, or of one that head() gave: later publications don't touch them."""
    e = at or head(spark, root)
    if not e:
        return graph_of(spark)
    return Graph(**{name: spark.read.schema(schema).parquet(f"{e.tables}/{name}") for name, schema in SCHEMAS.items()})


def stamped(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows labelled with the state they were read at."""
    one = F.broadcast(state.limit(1).select("instance_id", "generation", F.lit(True).alias("graph_state_verified")))
    return rows.crossJoin(one)
