"""Means that lie between two roundings are the same whatever order their sums had."""

from evidentia.plans import measures


def test_separation_rounds_a_tie_up(spark, monkeypatch):
    # their mean is 0.4835355; added in this order as doubles it is one bit less
    bad = [0.028586, 0.011016, 0.825082, 0.970565, 0.309906, 0.761773, 0.625549, 0.335807]
    rows = spark.createDataFrame([(1, v, v, v, v) for v in bad] + [(0, *[0.2500001] * 4)], "y int, unsupport double, anomaly double, injection double, conflict double").coalesce(1)
    monkeypatch.setattr(measures, "_retrieved", lambda spark, sf_dir: rows)
    found = measures.signal_separation(spark, "").collect()
    assert len(found) == 4 and {(r.mean_poisoned, r.mean_clean, r.difference) for r in found} == {(0.483536, 0.25, 0.233535)}
