"""Thresholds as data, exact quantiles and exact clusters, against plain versions."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import judgement as J
from evidentia.operators import signals as S
from evidentia.operators import thresholds as T
from evidentia.operators.quantiles import quantiles


def test_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(5)
    groups = {"one": [0.25], "flat": [0.5] * 900, "thirds": [0.0] * 300 + list(rng.random(600)), "wide": list(rng.normal(0, 3, 500)), "close": list(0.5 + rng.random(400) * 1e-5)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    found = {(r.g, r.q): (r.n, r.value) for r in quantiles(rows, ["g"], F.col("v"), (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)).collect()}
    assert len(found) == 5 * 6
    for (g, q), (n, value) in found.items():
        assert n == len(groups[g]) and value == pytest.approx(np.quantile(np.round(groups[g], 9), q), abs=1e-9), (g, q)


def fitted(spark, **of):
    rows = [(s, v) for s, vs in of.items() for v in vs]
    return {r.signal: r for r in T.fitted(spark.createDataFrame(rows, "signal string, v double")).collect()}


def test_thresholds_say_why_they_are_missing(spark):
    spread = [k / 100 for k in range(100)]
    t = fitted(spark, unsupport=spread, anomaly=[0.4] * 50, injection=[0.0] * 90, conflict=[None, None])
    assert (t["unsupport"].origin, t["unsupport"].suspicious, t["unsupport"].malicious) == ("fitted", pytest.approx(0.9405), pytest.approx(0.9801))
    assert t["anomaly"].unusable == "flat: would never fire" and t["anomaly"].suspicious is None
    assert (t["injection"].origin, t["injection"].suspicious, t["injection"].malicious, t["injection"].unusable) == ("declared", 0.6, 0.9, None)
    assert t["conflict"].unusable == "never read" and t["conflict"].n == 0
    t = fitted(spark, unsupport=[0.0] * 99 + [1.0], anomaly=[0.1] * 19, conflict=[1.0] * 97 + [0.2] * 3)
    assert t["unsupport"].unusable == "flat: would always fire" and t["conflict"].unusable == "flat: would never fire"
    assert (t["anomaly"].origin, t["anomaly"].suspicious, t["anomaly"].malicious) == ("fallback", 0.6, 0.85)
    t = fitted(spark, unsupport=[0.1] * 10 + [0.7] * 40)
    assert t["unsupport"].malicious == pytest.approx(0.700001)


def test_thresholds_are_saved(spark, tmp_path):
    rows = T.fitted(spark.createDataFrame([("unsupport", k / 50) for k in range(50)], "signal string, v double"))
    T.save(rows, f"{tmp_path}/cuts")
    T.save(rows, f"{tmp_path}/cuts")
    assert sorted(map(tuple, T.load(spark, f"{tmp_path}/cuts").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


DOC = "rnk int, doc_id long, score double, source string, tier int, entailment double, unsupport double, anomaly double, injection double, conflict double"


def test_a_signal_without_threshold_decides_nothing(spark):
    docs = [(1, 1, 1.0, "a", 2, 0.0, 1.0, 1.0, 0.0, 1.0)]
    rows = spark.createDataFrame([(1, docs)], f"query_id long, docs array<struct<{DOC.replace(' ', ': ').replace(',:', ',')}>>")
    assert J.classified(rows).first().band == "MALICIOUS"
    spread = [("unsupport", k / 50) for k in range(50)]
    dead = T.joined(rows, T.fitted(spark.createDataFrame(spread + [("anomaly", 0.5)] * 30, "signal string, v double")))
    r = J.classified(dead).first()
    assert (r.band, r.rule) == ("SUSPICIOUS", "one_suspicious") and r.outliers == 1


def plain(x):
    """Distances to cluster means of the best split, over all splits."""
    n = len(x)
    splits = [s for s in product((0, 1), repeat=n) if s[-1] == 0 and any(s)] if n >= 4 else [(0,) * n]
    cost = lambda s: round(sum(((x[np.array(s) == c] - x[np.array(s) == c].mean(0)) ** 2).sum() for c in set(s)), 9)
    best = min(splits, key=lambda s: (cost(s), sum(b << k for k, b in enumerate(s))))
    where = np.array(best)
    return [float(np.linalg.norm(x[i] - x[where == where[i]].mean(0))) for i in range(n)]


def test_clusters_are_the_best_split(spark):
    rng = np.random.default_rng(11)
    sets = [rng.normal(size=(n, 6)) for n in (1, 2, 3, 4, 5, 5, 5, 5)] + [np.zeros((5, 6)), np.repeat(rng.normal(size=(1, 6)), 5, 0), np.vstack([np.ones((2, 6)), -np.ones((3, 6))])]
    hits, vectors = [], []
    for q, x in enumerate(sets):
        for r, v in enumerate(x, 1):
            hits.append((q, q * 100 + r, r))
            vectors += [(q * 100 + r, k, float(w)) for k, w in enumerate(v) if w]
    hits = spark.createDataFrame(hits, "query_id long, doc_id long, rnk int")
    gram = S.gram(hits, spark.createDataFrame(vectors, "doc_id long, idx long, v double"))
    rows = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("n")).join(gram, "query_id", "left").withColumn("gram", F.coalesce("gram", F.array().cast("array<struct<i: int, j: int, g: double>>")))
    rows = rows.withColumn("mask", S.clusters(F.col("n"), F.col("gram")))
    found = {r.query_id: r.d for r in rows.select("query_id", S.distances(F.col("n"), F.col("gram"), F.col("mask")).alias("d")).collect()}
    for q, x in enumerate(sets):
        assert found[q] == pytest.approx(plain(x), abs=2e-5), q


def test_a_fact_that_the_report_does_not_bear_out_is_found(spark):
    from evidentia.operators import report as P
    from evidentia.plans import reports

    rows = reports._reported(spark, "/root/testdata/sf0.001")
    assert P.resolved(rows).where("not resolved").isEmpty() and rows.where(F.size(P.ungrounded()) > 0).isEmpty()
    spoilt = rows.withColumn("report", F.regexp_replace("report", r'"n_sources":\d+', '"n_sources":77'))
    assert {r.slot for r in P.resolved(spoilt).where("not resolved").select("slot").distinct().collect()} <= {"n_sources"}
    assert P.resolved(spoilt).where("not resolved").count() == P.resolved(rows).where("slot = 'n_sources' and said <> '77'").count() > 0
    unfitted = P.reported(rows.drop("sentences", "caveats", "report"), "now", model_fitted=False)
    told = unfitted.select("query_id", F.explode("sentences.template_id").alias("t")).groupBy("t").count().collect()
    names = {r.t for r in told}
    assert {"model_unfitted", "composite_absent", "backend_fallback"} <= names and "composite_score" not in names and P.resolved(unfitted).where("not resolved").isEmpty()
