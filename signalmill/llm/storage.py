"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), one of our own."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="signalmill-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/signalmill/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    """A setting of the session, for as long as this lasts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, *, spread: bool = False) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    After a shuffle, partitions are merged up to Spark's advisory size, so that small
    tables are few files; with spread they stay as many as there are tasks to run at
    once, for tables that cost more to compute than their size tells.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with contextlib.nullcontext() if spread else _conf(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of so many rows at most, of a few numbers each, is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 100_000


def smaller(table: DataFrame, items: Column | None = None) -> DataFrame:
    """The table, to be broadcast if its counted rows are few enough; of tables with arrays, items of a row count as rows do."""
    weight = F.lit(1) if items is None else 1 + F.greatest(items, F.lit(0))
    size = table.limit(BROADCAST_ROWS + 1).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first().n
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


#: Rows of an Arrow batch of whole texts; Spark's own 10,000 make tens of MB with as many copies.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches, so that Python workers stay small; for entry points, whose session it is.

    Operators leave the caller's session as it is, and work through any batch in pieces.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/signalmill/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def trimmed() -> None:
    """Give memory that this worker has freed back to the system: it outlives stages, and freed blocks add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_state() -> dict:
    """A dictionary that lives as long as this Python worker does."""
    name = "_signalmill_worker_state"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.state = {}
        sys.modules[name] = module
    return sys.modules[name].state
