"""How long each stage of a batch takes, and what that is for one query."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.storage import written
from evidentia.operators.quantiles import quantiles

SCHEMA = "run string, stage string, place int, rows long, ms double, queries long"
#: Milliseconds that runs are counted up to, so that their quantiles are found in cells.
LONGEST = 1e8


class Profile:
    """Times stages as they are written; rows are counted by an observation on the way, without a pass of their own."""

    def __init__(self, spark: SparkSession, run: str, queries: int):
        self.spark, self.run, self.queries = spark, run, queries
        self.told: list[tuple] = []

    def stage(self, name: str, make) -> DataFrame:
        """Writes what ``make()`` gives and reads it back; its planning counts as well."""
        seen, began = Observation(name), time.perf_counter()
        out = written(make().observe(seen, F.count(F.lit(1)).alias("rows")), name)
        took = 1000 * (time.perf_counter() - began)
        self.told.append((self.run, name, len(self.told), int(seen.get["rows"]), took, self.queries))
        return out

    def records(self) -> DataFrame:
        return self.spark.createDataFrame(self.told, SCHEMA)


def breakdown(records: DataFrame) -> DataFrame:
    """(run, stage, place, rows, ms, ms_per_query, share) of each stage, and of each run as stage total."""
    whole = records.groupBy("run").agg(F.sum("ms").alias("all"), F.max("queries").alias("queries"), F.max("place").alias("last"))
    each = records.join(whole.select("run", "all"), "run").select("run", "stage", "place", "rows", "ms", F.try_divide("ms", F.col("queries")).alias("ms_per_query"), F.try_divide("ms", F.col("all")).alias("share"))
    total = whole.select("run", F.lit("total").alias("stage"), (F.col("last") + 1).alias("place"), F.col("queries").alias("rows"), F.col("all").alias("ms"), F.try_divide("all", F.col("queries")).alias("ms_per_query"), F.lit(1.0).alias("share"))
    return each.unionByName(total)


def summary(log: DataFrame) -> DataFrame:
    """(stage, runs, mean_ms, median_ms, p95_ms) per query over all runs of a log; the p95 is the value at that place, none between two."""
    rows = breakdown(log).where("ms_per_query is not null")
    q = quantiles(rows, ["stage"], F.col("ms_per_query") / LONGEST, (0.5, 0.95)).groupBy("stage").agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("half"), F.max(F.when(F.col("q") == 0.95, F.col("lower"))).alias("most"))
    mean = rows.groupBy("stage").agg(F.count("*").alias("runs"), F.round(F.avg("ms_per_query"), 3).alias("mean_ms"))
    return mean.join(q, "stage").select("stage", "runs", "mean_ms", F.round(F.col("half") * LONGEST, 3).alias("median_ms"), F.round(F.col("most") * LONGEST, 3).alias("p95_ms"))
