"""Session, storage and worker helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.storage import shared_dir, written

__all__ = ["ascii_lower", "document_key", "give_back", "mapped", "shared_dir", "stored", "table"]

#: Rows of whole texts that go to a Python worker at once.  A batch stands in each task outside the
#: executor's heap, and again in the worker; Spark's own bound is 10,000 rows.
BATCH_ROWS = 2000

#: Bytes of rows that go to a Python worker at once, beyond which a batch ends before it has BATCH_ROWS
#: rows.  One longer row is a batch of its own.
BATCH_BYTES = 64 << 20

#: Writes a table in the shared folder, which cuts the lineage, and reads it back.
stored = written


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package, wherever the driver was started.

    A cluster gets it with --py-files or an installed package.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes in this session; smaller settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    now = spark.conf.get(size).lower()
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(size, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(collect: bool = True) -> None:
    """Returns this process's unused memory to the machine."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with workers that find this package and give unused memory back after every batch.

    A worker outlives its task, and what it keeps stands beside the executor's heap in later stages.
    Batches are bounded in rows and bytes from here on in this session, as Spark has no such setting
    for one plan.
    """
    reachable(df.sparkSession)
    small_batches(df.sparkSession)

    def watched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back(collect=False)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(watched(batches))

    return df.mapInArrow(wrapped, schema)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does exactly that for a text of ASCII only and is much faster than ``translate``.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell documents apart: rows with the same id and the same text are one document."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("t"), text), F.lit("n")))))
