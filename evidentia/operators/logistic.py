"""Weighted logistic models fitted by Newton steps whose sums are Spark aggregates.

Any number of small models is fitted at once, one for each value of ``model``: each step is one
group-by with map-side sums of ``d + d * (d + 1) / 2`` expressions, and only those sums reach the
driver.  So folds, strengths and bootstrap resamples share each pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.storage import written
from evidentia.operators import sweep
from evidentia.operators.folds import stratified_folds, with_folds
from evidentia.operators.resample import exploded, resampled

#: Cost of a missed positive against a false alarm; strengths tried; resamples; folds.
POSITIVE_WEIGHT = 10.0
STRENGTHS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
RESAMPLES = 200
FOLDS = 5
#: Folds of the calibrated ensemble, and the strength that leaves a sigmoid as free as can be.
CALIBRATIONS, UNBOUNDED = 3, 1e6


def standardised(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features minus their mean over their population deviation (0 counts as 1); nulls become 0 first."""
    clean = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    moments = clean.agg(*[F.avg(f).alias(f"{f}_mean") for f in features], *[F.stddev_pop(f).alias(f"{f}_dev") for f in features]).first()
    scaled = {f: (F.col(f) - float(moments[f"{f}_mean"] or 0.0)) / float(moments[f"{f}_dev"] or 1.0) for f in features}
    return clean.withColumns(scaled)


def _logit(features: Sequence[str], coefficients: dict[str, str]):
    return sum((F.col(f) * F.col(c) for f, c in coefficients.items() if f in features), F.col("b0"))


def fit(rows: DataFrame, features: Sequence[str], strengths: dict[object, float], steps: int = 50, tol: float = 1e-9) -> dict[object, np.ndarray]:
    """{model: (intercept, coefficients...)} for rows (model, y, w, features).

    Minimises ``|b|^2 / 2 + C * sum(w * loss)`` for each model, the intercept unpenalised, with C
    from ``strengths``.  Models whose rows have one class only, or no rows, are left out.
    """
    spark, d = rows.sparkSession, len(features) + 1
    kinds = rows.where("w > 0").groupBy("model").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo <> hi").collect()
    beta = {r["model"]: np.zeros(d) for r in kinds if r["model"] in strengths}
    schema = f"model {rows.schema['model'].dataType.simpleString()}, " + ", ".join(f"b{i} double" for i in range(d))
    columns = [F.lit(1.0), *[F.col(f) for f in features]]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    active = set(beta)
    for _ in range(steps):
        if not active:
            break
        now = spark.createDataFrame([(m, *map(float, beta[m])) for m in active], schema)
        margin = _logit(features, {f: f"b{i + 1}" for i, f in enumerate(features)})
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
        near = rows.join(F.broadcast(now), "model").withColumn("margin", margin).withColumn("p", p)
        gradient = [F.sum(F.col("w") * (F.col("y") - F.col("p")) * c).alias(f"g{i}") for i, c in enumerate(columns)]
        curvature = [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * columns[i] * columns[j]).alias(f"h{i}_{j}") for i, j in pairs]
        for r in near.groupBy("model").agg(*gradient, *curvature).collect():
            m, ridge = r["model"], np.diag([0.0] + [1.0] * (d - 1))
            g = strengths[m] * np.array([r[f"g{i}"] for i in range(d)]) - ridge @ beta[m]
            h = np.zeros((d, d))
            for i, j in pairs:
                h[i, j] = h[j, i] = strengths[m] * r[f"h{i}_{j}"]
            move = np.linalg.solve(h + ridge + 1e-12 * np.eye(d), g)
            move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-300))
            beta[m] = beta[m] + move
            if np.abs(move).max() < tol:
                active.discard(m)
    return beta


def weighted(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("y", F.col(label).cast("double")).withColumn("w", F.when(F.col(label) == 1, POSITIVE_WEIGHT).otherwise(1.0))


def margins(rows: DataFrame, features: Sequence[str], beta: dict[object, np.ndarray]) -> DataFrame:
    """``rows`` with the margin of their own model."""
    d = len(features) + 1
    schema = f"model {rows.schema['model'].dataType.simpleString()}, " + ", ".join(f"b{i} double" for i in range(d))
    table = rows.sparkSession.createDataFrame([(m, *map(float, b)) for m, b in beta.items()], schema)
    margin = _logit(features, {f: f"b{i + 1}" for i, f in enumerate(features)})
    return rows.join(F.broadcast(table), "model").withColumn("margin", margin).drop(*[f"b{i}" for i in range(d)])


def _outside(rows: DataFrame, folds: int, strengths: Sequence[float]) -> tuple[DataFrame, DataFrame, dict[int, float]]:
    """Training and held-out rows, which have a fold, of every (strength, fold); model = strength's place * folds + fold."""
    every = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(strengths) * folds - 1))))
    held = F.col("model") % folds == F.col("fold")
    return every.where(~held), every.where(held), {k: strengths[k // folds] for k in range(len(strengths) * folds)}


def folded(rows: DataFrame, label: str, group: str, folds: int = FOLDS) -> DataFrame:
    """``weighted`` rows in stratified folds of whole groups, written, as every step of a fit reads them."""
    return written(with_folds(weighted(rows, label), stratified_folds(rows, group, label, folds), group), "folded")


def choose_strength(rows: DataFrame, features: Sequence[str], label: str, group: str, strengths: Sequence[float] = STRENGTHS) -> float:
    """The strength with the best mean average precision over grouped folds; 1.0 with fewer than ten positives."""
    if rows.where(F.col(label) == 1).count() < 10:
        return 1.0
    train, held, table = _outside(folded(rows, label, group), FOLDS, strengths)
    # rounded, as equal rows may differ in their last bits
    scored = margins(held, features, fit(train, features, table)).withColumn("margin", F.round("margin", 9))
    # swept by score, so that no task sees all rows of a model
    squashed = scored.select("model", F.col("y").cast("int").alias("y"), F.round(1 / (1 + F.exp(-F.col("margin"))), 12).alias("s"))
    table = sweep.swept(squashed, ["model"]).where("n_pos > 0")
    precision = table.groupBy("model").agg(F.sum(F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap")).collect()
    by: dict[int, list[float]] = {}
    for r in precision:
        by.setdefault(r["model"] // FOLDS, []).append(r["ap"])
    best = max(by, key=lambda k: (round(float(np.mean(by[k])), 9), -k), default=None)
    return 1.0 if best is None else strengths[best]


def calibrate(rows: DataFrame, features: Sequence[str], label: str, group: str, strength: float) -> tuple[float, float]:
    """(intercept, slope) of the one sigmoid that maps all out-of-fold margins to probabilities."""
    train, held, table = _outside(folded(rows, label, group), FOLDS, [strength])
    out = margins(held, features, fit(train, features, table)).select(F.lit(0).alias("model"), "y", F.lit(1.0).alias("w"), "margin")
    found = fit(out.withColumnRenamed("margin", "x0"), ["x0"], {0: UNBOUNDED})
    return tuple(map(float, found.get(0, (0.0, 1.0))))


def calibrated(rows: DataFrame, features: Sequence[str], label: str, group: str, strength: float) -> DataFrame:
    """The calibrated ensemble as a relation: (model, b0, b1, ..., intercept, slope), one row for each fold.

    As many folds as there are positives, two at least and ``CALIBRATIONS`` at most.  A fold's model is fitted outside of the fold and its
    sigmoid inside; a fold that has one class only is left out.
    """
    positives = rows.where(F.col(label) == 1).count()
    folds = min(CALIBRATIONS, max(2, positives))
    train, held, table = _outside(folded(rows, label, group, folds), folds, [strength])
    beta = fit(train, features, table)
    out = margins(held, features, beta).select("model", "y", F.lit(1.0).alias("w"), F.col("margin").alias("x0"))
    sigmoids = fit(written(out, "margins"), ["x0"], {k: UNBOUNDED for k in beta})
    schema = "model int, " + ", ".join(f"b{i} double" for i in range(len(features) + 1)) + ", intercept double, slope double"
    return rows.sparkSession.createDataFrame([(int(m), *map(float, beta[m]), *map(float, sigmoids[m])) for m in sorted(beta) if m in sigmoids], schema)


def probabilities(rows: DataFrame, features: Sequence[str], ensemble: DataFrame, key: str) -> DataFrame:
    """(key, p): the mean over the ensemble of each member's calibrated probability; null without members."""
    margin = _logit(features, {f: f"b{i + 1}" for i, f in enumerate(features)})
    met = rows.crossJoin(F.broadcast(ensemble))  # CALIBRATIONS rows at most
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * margin)))
    return met.groupBy(key).agg(F.avg(p).alias("p"))


def bootstrap(rows: DataFrame, features: Sequence[str], label: str, key: str, strength: float, resamples: int = RESAMPLES) -> dict[int, np.ndarray]:
    """One model for each resample of as many rows as there are; resamples of one class are left out."""
    every = exploded(resampled(weighted(rows, label), key, resamples)).withColumn("w", F.col("w") * F.col("times"))
    return fit(every, features, {k: strength for k in range(1, resamples + 1)}, tol=1e-6)
