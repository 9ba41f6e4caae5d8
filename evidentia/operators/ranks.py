"""Places within groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.storage import written


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) within their group ``by``, in ascending ``order``; equal rows come in any order.

    Rows are range-partitioned and sorted once and written; a place is that in its partition and what the partitions before
    hold of its group.  A group of any size is spread over many partitions.  Keys must not be null.
    """
    by, order = list(by), list(order)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(parts, *by, *order, "_spread")
    ordered = written(spread.sortWithinPartitions(*by, *order, "_spread").drop("_spread").withColumn("_at", F.monotonically_increasing_id()), "placed")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy(*by, "_part").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_part", (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.join(counts, [*by, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).select(*rows.columns, "place")
