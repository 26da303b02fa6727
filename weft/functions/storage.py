"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all executors at most.
MOST_BROADCAST = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set before. On one machine (a local master) a new
    folder is made and set where there is none; on a cluster that is an error."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(configured)
        return configured
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weft-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


#: The folder that owns what is stored now, of each thread.
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


def owned_dir(spark: SparkSession) -> str:
    """The folder that owns what is stored now, or the shared one."""
    return _OWNER.get() or shared_dir(spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that are stored or checkpointed inside go into a folder of their own, which is
    deleted at the end, also after a failure. What is built from them has to be written inside."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _OWNER.set(folder)
    try:
        yield folder
    finally:
        _OWNER.reset(token)
        _delete(spark, folder)


def written(spark: SparkSession, build: Callable[[], DataFrame], path: str, mode: str = "error", **options: str) -> DataFrame:
    """The table that `build` makes, written as Parquet and read from there; all that was
    stored on the way is gone afterwards."""
    with scratch(spark):
        out = build()
        out.write.mode(mode).options(**options).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a copy in the shared folder, which outlives lost executors."""
    if _OWNER.get():
        return stored(df)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The table written to the shared folder as compressed Parquet, and read from there."""
    path = f"{owned_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table, to be sent to all executors if it has at most `most` rows (narrow ones)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are stored. Its cleaner learns of them
    when the driver collects garbage, which may be long after (spark.cleaner.periodicGC.interval),
    and only once another job has followed."""
    gc.collect()  # DataFrames in reference cycles keep their plans alive
    spark.range(2).repartition(2).count()
    spark.sparkContext._jvm.System.gc()
