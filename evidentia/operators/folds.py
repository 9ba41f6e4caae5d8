"""Folds of whole groups with alike shares of both classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.storage import written

#: Groups that are placed one by one, the largest; each of the others is smaller than any of these.
GREEDY = 10_000
#: Fold tables up to so many groups are broadcast.
BROADCAST_GROUPS = 200_000


def _place(groups: list[tuple[float, float]], k: int, totals: tuple[float, float]) -> tuple[list[int], np.ndarray]:
    """The fold of each group (negatives, positives), largest difference first, and what the folds hold then."""
    held, out = np.zeros((k, 2)), []
    whole = np.maximum(np.array(totals, dtype=float), 1e-300)
    for counts in groups:
        tried = np.repeat((held / whole)[None], k, axis=0)
        tried[np.arange(k), np.arange(k)] += np.array(counts) / whole
        spread = np.round(tried.std(axis=1).mean(axis=1), 12)
        fold = min(range(k), key=lambda f: (spread[f], held[f].sum(), f))
        held[fold] += counts
        out.append(fold)
    return out, held


def stratified_folds(rows: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """(group, pos, neg, fold), one row for each group of ``rows``; ``label`` is 0 or 1, other labels are not counted.

    Groups come with the largest difference of their classes first, ties by name, and each goes where the
    classes' shares differ least between the folds, then to the fold with the fewest rows.  That looks at the
    ``GREEDY`` largest groups only, on the driver; of what remains every group is small, and they are dealt in turn
    within 256 hash parts and by whether they have a positive row.  A null group is a group like any other.
    """
    per = rows.where(F.col(label).isin(0, 1)).groupBy(F.col(group).cast("string").alias("group")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    per = written(per.withColumn("h", F.xxhash64(F.coalesce(F.concat(F.lit("="), "group"), F.lit("-")))), "groups")
    totals = per.agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.count("*").alias("n")).first()
    large = per.orderBy(F.desc(F.col("pos") + F.col("neg")), "group").limit(GREEDY).collect()
    large.sort(key=lambda r: (-abs(r["pos"] - r["neg"]), r["group"] is not None, (r["group"] or "").encode()))
    folds, held = _place([(r["neg"], r["pos"]) for r in large], k, (totals["neg"] or 0, totals["pos"] or 0))
    placed = rows.sparkSession.createDataFrame([(r["group"], r["pos"], r["neg"], f) for r, f in zip(large, folds, strict=True)], "group string, pos long, neg long, fold int")
    if totals["n"] <= GREEDY:
        return placed
    order = [int(f) for f in np.argsort(held.sum(axis=1), kind="stable")]
    rest = per.join(F.broadcast(placed.select(F.col("group").alias("g"))), F.col("group").eqNullSafe(F.col("g")), "left_anti")
    turn = F.row_number().over(Window.partitionBy(F.pmod("h", F.lit(256)), F.col("pos") > 0).orderBy(F.desc(F.col("pos") + F.col("neg")), "h"))
    rest = rest.select("group", "pos", "neg", F.get(F.array(*map(F.lit, order)), F.pmod(turn - 1 + F.pmod("h", F.lit(256)), F.lit(k)).cast("int")).alias("fold"))
    return placed.unionByName(rest)


def with_folds(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """``rows`` with the fold of their group; rows of a group without a fold go."""
    folds = folds.select(F.col("group").alias("_group"), "fold")
    small = F.broadcast(folds) if folds.count() <= BROADCAST_GROUPS else folds
    return rows.join(small, F.col(group).cast("string").eqNullSafe(F.col("_group"))).drop("_group")
