"""Streams: new queries scored as they arrive, and windowed counts of audit events.  Both are ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, incoming: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score every new file of queries under ``incoming`` and put the result in ``out``.

    Each micro-batch has its own folder, which a repeated batch overwrites: so each query is
    counted once even when a batch runs again after a failure.
    """

    def batch(queries: DataFrame, number: int) -> None:
        score(queries).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events (ts, event_type) per window and type; later rows than ``late`` are ignored in a stream."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n")
