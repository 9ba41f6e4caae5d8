"""Intermediate tables in the folder that the driver and every executor can reach."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)

#: Used only by a session that names no shared folder and runs on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: After so many written tables what the driver no longer names is collected.
RELEASE_EVERY = 8
_written = 0


def release(spark: SparkSession) -> None:
    """Has both halves of the driver collect their garbage.

    Spark removes the shuffle files and broadcasts of finished plans when the driver's JVM collects the
    plans, which a roomy heap puts off for long, while a chain of many small plans fills the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master may go without, a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def owned(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with its scratch, or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = owned(spark, name)
    df.write.parquet(path)
    global _written
    _written += 1
    if _written % RELEASE_EVERY == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Gathers the paths of tables that are written inside, and removes those that are still listed at its end.

    What is to stay is taken off the list.  Nothing that is left to compute may read what goes.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)
