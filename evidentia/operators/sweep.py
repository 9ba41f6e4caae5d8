"""Counts at every threshold of a score, without sending all scores through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells that scores from 0 to 1 are counted in; their sums are all that one task sees.
CELLS = 1024


def swept(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``scores`` (y 0 or 1, s from 0 to 1) to one row for each distinct s, within each group ``by``.

    t is the score, pos and neg its own counts, tp and fp those of all scores that reach it, n_pos and
    n_neg those of all.  A score is ordered within its cell only; nulls are left out.
    """
    by = by or []
    each = scores.where("y is not null and s is not null").groupBy(*by, F.col("s").alias("t")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    each = each.withColumn("cell", F.floor(F.greatest(F.least("t", F.lit(1.0)), F.lit(0.0)) * CELLS))
    cells = each.groupBy(*by, "cell").agg(F.sum("pos").alias("cell_pos"), F.sum("neg").alias("cell_neg"))
    above = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    cells = cells.withColumns({
        "above_pos": F.coalesce(F.sum("cell_pos").over(above), F.lit(0)), "above_neg": F.coalesce(F.sum("cell_neg").over(above), F.lit(0)),
        "n_pos": F.sum("cell_pos").over(whole), "n_neg": F.sum("cell_neg").over(whole),
    }).drop("cell_pos", "cell_neg")
    run = Window.partitionBy(*by, "cell").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    out = each.withColumns({"own_pos": F.sum("pos").over(run), "own_neg": F.sum("neg").over(run)}).join(cells, [*by, "cell"])
    return out.select(*by, "t", "pos", "neg", (F.col("above_pos") + F.col("own_pos")).alias("tp"), (F.col("above_neg") + F.col("own_neg")).alias("fp"), "n_pos", "n_neg")


def auc(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The share of pairs of a positive and a negative row that the score orders rightly; ties count half."""
    right = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp")) + F.col("pos") * F.col("neg") / 2)
    return table.groupBy(*(by or [])).agg(F.round(F.coalesce(F.try_divide(right, F.max("n_pos") * F.max("n_neg")), F.lit(0.0)), 6).alias("auc"))


def average_precision(table: DataFrame) -> DataFrame:
    """The sum over thresholds of the recall that each adds times its precision."""
    return table.agg(F.round(F.sum(F.try_divide(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("ap"))


def recall_within(table: DataFrame, budget: float) -> DataFrame:
    """The best recall whose share of false alarms stays in the budget, and the lowest such threshold."""
    fits = table.where(F.coalesce(F.try_divide(F.col("fp"), F.col("n_neg")), F.lit(0.0)) <= budget).select("t", F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), F.lit(0.0)).alias("recall"))
    best = fits.agg(F.max("recall").alias("recall"), F.min_by("t", F.struct(-F.col("recall"), F.col("t"))).alias("t"))
    found = F.coalesce("recall", F.lit(0.0))
    return best.select(F.round(found, 6).alias("recall"), F.round(F.when(found > 0, F.col("t")).otherwise(1.0), 6).alias("threshold"))


def thresholds(table: DataFrame, recall: float = 0.95, precision: float = 0.90) -> DataFrame:
    """tau_review, the highest threshold that reaches the recall; tau_reject, the lowest that reaches the
    precision; and the regime that follows.  0 and 1 are candidates beside the scores."""
    ends = table.agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.max(F.when(F.col("t") >= 1, F.col("tp"))).alias("tp"), F.max(F.when(F.col("t") >= 1, F.col("fp"))).alias("fp"))
    zero = ends.select(F.lit(0.0).alias("t"), F.col("n_pos").alias("tp"), F.col("n_neg").alias("fp"), "n_pos")
    one = ends.select(F.lit(1.0).alias("t"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), "n_pos")
    every = table.select("t", "tp", "fp", "n_pos").unionByName(zero).unionByName(one)
    reach = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), F.lit(0.0)) >= recall
    sure = (F.col("tp") > 0) & (F.col("tp") >= precision * (F.col("tp") + F.col("fp")))
    out = every.agg(F.coalesce(F.max(F.when(reach, F.col("t"))), F.lit(1.0)).alias("tau_review"), F.min(F.when(sure, F.col("t"))).alias("reject"))
    out = out.select("tau_review", F.coalesce("reject", F.lit(1.0)).alias("tau_reject"), F.col("reject").isNotNull().alias("reject_reachable"))
    consistent = F.col("reject_reachable") & (F.col("tau_review") < F.col("tau_reject"))
    return out.select(F.round("tau_review", 6).alias("tau_review"), F.round("tau_reject", 6).alias("tau_reject"), "reject_reachable", consistent.alias("bands_consistent"), F.when(consistent, "three_band").otherwise("review_only").alias("regime"), (F.col("tau_review") > 0).alias("review_band_informative"))


def best_success(table: DataFrame, alarms) -> DataFrame:
    """The least share of positives that pass where the share of false alarms is at most ``alarms``."""
    fits = table.where(F.coalesce(F.try_divide(F.col("fp"), F.col("n_neg")), F.lit(0.0)) <= alarms)
    return fits.agg(F.coalesce(F.min(1 - F.col("tp") / F.col("n_pos")), F.lit(1.0)).alias("asr"))
