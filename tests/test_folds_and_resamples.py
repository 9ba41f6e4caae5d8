"""Folds of groups, resamples of fixed size and the calibrated ensemble against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import folds, logistic
from evidentia.operators import resample as R


def grouped(spark, n=90):
    rng = np.random.default_rng(8)
    rows = [(f"g{g}" if g else None, int(rng.random() < (0.6 if g % 7 == 0 else 0.1))) for g in range(n) for _ in range(int(rng.integers(1, 30)))]
    return rows, spark.createDataFrame(rows + [("g1", None), ("only null", None)], "grp string, y int")


@pytest.mark.parametrize("greedy", [10_000, 12])
def test_folds_keep_groups_and_shares(spark, monkeypatch, greedy):
    monkeypatch.setattr(folds, "GREEDY", greedy)
    rows, table = grouped(spark)
    found = {r.group: r for r in folds.stratified_folds(table, "grp", "y").collect()}
    assert set(found) == {g for g, _ in rows}
    pos, neg = Counter(g for g, y in rows if y), Counter(g for g, y in rows if not y)
    assert all((r.pos, r.neg) == (pos[g], neg[g]) for g, r in found.items())
    share = lambda of: [sum(of[g] for g, r in found.items() if r.fold == k) / sum(of.values()) for k in range(5)]
    off = max(map(abs, np.array(share(pos) + share(neg)) - 0.2))
    assert off < (0.03 if greedy > 90 else 0.12), off
    met = folds.with_folds(table, spark.createDataFrame([(g, r.fold) for g, r in found.items()], "group string, fold int"), "grp")
    assert met.where("y is not null").count() == len(rows) and met.groupBy("grp").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty()


def test_no_rows_have_no_folds(spark):
    _, table = grouped(spark, 2)
    assert folds.stratified_folds(table.where("false"), "grp", "y").isEmpty()


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_every_resample_has_as_many_rows(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(R, "CELL_ROWS", cell_rows)
    table = spark.createDataFrame([(k // 2, k % 3) for k in range(500)] + [(None, 1)], "id long, x int")
    found = R.resampled(table, "id", 30).collect()
    times = np.array([r.times for r in found])
    assert times.shape == (501, 30) and (times.sum(axis=0) == 501).all()
    assert abs((times == 0).mean() - np.exp(-1)) < 0.02 and abs(times.var() - 1) < 0.05
    again = R.resampled(table.repartition(7), "id", 30).collect()
    key = lambda rows: sorted((str(r.id), r.x, tuple(r.times)) for r in rows)
    assert key(found) == key(again)
    each = R.exploded(R.resampled(table, "id", 30)).groupBy("model").agg(F.sum("times").alias("n")).collect()
    assert {(r.model, r.n) for r in each} == {(k, 501) for k in range(1, 31)}


def test_the_ensemble_is_the_mean_of_its_calibrated_folds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2))
    y = (rng.random(240) < 1 / (1 + np.exp(1 - x @ [1.5, -1.0]))).astype(int)
    table = spark.createDataFrame([(i, f"g{i % 40}", int(y[i]), *map(float, x[i])) for i in range(240)], "doc_id long, source string, toxic int, x0 double, x1 double")
    ensemble = logistic.calibrated(table, ["x0", "x1"], "toxic", "source", 1.0)
    members = ensemble.collect()
    assert len(members) == 3
    fold = {r.group: r.fold for r in folds.stratified_folds(table, "source", "toxic", 3).collect()}
    where = np.array([fold[f"g{i % 40}"] for i in range(240)])
    full = np.hstack([np.ones((240, 1)), x])
    for m in members:
        beta = np.array([m.b0, m.b1, m.b2])
        train = where != m.model
        w = np.where(y == 1, 10.0, 1.0)
        gradient = full[train].T @ (w * (y - 1 / (1 + np.exp(-full @ beta))))[train] - np.array([0, *beta[1:]])
        assert np.abs(gradient).max() < 1e-5
        margin = (full @ beta)[~train]
        slip = y[~train] - 1 / (1 + np.exp(-(m.intercept + m.slope * margin)))
        assert abs(slip.sum()) < 1e-3 and abs((slip * margin).sum()) < 1e-3
    want = np.mean([1 / (1 + np.exp(-(m.intercept + m.slope * (full @ [m.b0, m.b1, m.b2])))) for m in members], axis=0)
    found = {r.doc_id: r.p for r in logistic.probabilities(table, ["x0", "x1"], ensemble, "doc_id").collect()}
    assert np.allclose([found[i] for i in range(240)], want, atol=1e-9)
