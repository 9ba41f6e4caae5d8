"""Exact quantiles of groups that no task holds whole: counts by cell, then the one cell that has the rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.storage import written

#: Places that values are rounded to, and cells from 0 to 1: a cell has at most 15,259 distinct values.
PLACES, CELLS = 9, 1 << 16


def quantiles(rows: DataFrame, by: Sequence[str], value: Column, at: Sequence[float]) -> DataFrame:
    """(by..., q, n, value, lower): for each group and each q of ``at`` the quantile of ``value``, linear between the neighbours, and the lower neighbour.

    Values are rounded to ``PLACES``; those below 0 or above 1 are right too, but share the first or last
    cell.  Null values are left out, groups without any have no row; keys must not be null.  Rows are
    counted by value on the map side, one task sees the cells of a group, and one the values of a cell.
    """
    by = list(by)
    each = rows.select(*by, F.round(value, PLACES).alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("k"))
    each = written(each.withColumn("cell", F.floor(F.greatest(F.least("v", F.lit(1.0)), F.lit(0.0)) * CELLS).cast("int")), "values")
    over = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = each.groupBy(*by, "cell").agg(F.sum("k").alias("size"))
    cells = cells.withColumns({"before": F.coalesce(F.sum("size").over(over), F.lit(0)), "n": F.sum("size").over(Window.partitionBy(*by))})
    wanted = cells.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("place", F.col("q") * (F.col("n") - 1))
    wanted = wanted.withColumns({"low": F.floor("place"), "high": F.ceil("place")})
    holds = lambda rank, start, size: (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(start) + F.col(size))
    wanted = wanted.where(holds("low", "before", "size") | holds("high", "before", "size"))
    within = Window.partitionBy(*by, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # only cells that hold a rank are ordered
    picked = each.join(wanted.select(*by, "cell", "before").distinct(), [*by, "cell"])
    picked = picked.withColumn("start", F.col("before") + F.coalesce(F.sum("k").over(within), F.lit(0))).select(*by, "cell", "v", "k", "start")
    met = wanted.select(*by, "cell", "q", "n", "place", "low", "high").join(picked, [*by, "cell"])
    found = met.groupBy(*by, "q", "n", "place", "low").agg(F.max(F.when(holds("low", "start", "k"), F.col("v"))).alias("a"), F.max(F.when(holds("high", "start", "k"), F.col("v"))).alias("b"))
    return found.select(*by, "q", "n", (F.col("a") + (F.col("place") - F.col("low")) * (F.col("b") - F.col("a"))).alias("value"), F.col("a").alias("lower"))
