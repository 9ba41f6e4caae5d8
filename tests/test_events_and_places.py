"""The audit log's events, latency summaries, and places in large groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import events as E
from evidentia.operators import profile as P
from evidentia.operators import ranks

SF = "/root/testdata/sf0.001"


def test_events_are_appended_once_and_whole(spark, tmp_path):
    from evidentia.plans import reports

    log = f"{tmp_path}/events"
    rows = E.recorded(reports._reported(spark, SF))
    assert E.read(spark, log) is None and E.faults(rows).isEmpty() and len(rows.columns) >= 45
    n = rows.count()
    assert E.append(rows.limit(10), log).count() == 10
    assert E.append(rows, log).count() == n and E.append(rows, log).count() == n
    assert E.read(spark, log).select("event_id").distinct().count() == n
    spoilt = rows.withColumn("headline_subtype", F.lit(None).cast("string")).withColumn("event_id", F.concat("event_id", F.lit("x")))
    with pytest.raises(ValueError, match="red without subtype"):
        E.append(spoilt, log)
    faults = E.faults(rows.withColumn("headline", F.when(F.col("n_retrieved") > 0, "BLUE")).withColumn("case_id", F.lit(None).cast("string")))
    assert {r.fault for r in faults.select("fault").distinct().collect()} >= {"unknown headline", "no case_id"}
    assert E.read(spark, log).count() == n


def test_latency_summary(spark):
    rng = np.random.default_rng(6)
    runs = [(f"r{k}", s, p, 10, float(rng.integers(1, 5000)), 40) for k in range(37) for p, s in enumerate(("retrieval", "signals"))]
    log = spark.createDataFrame(runs, P.SCHEMA)
    found = {r.stage: r for r in P.summary(log).collect()}
    of = {s: np.array([r[4] / 40 for r in runs if r[1] == s]) for s in ("retrieval", "signals")}
    of["total"] = of["retrieval"] + of["signals"]
    for stage, ms in of.items():
        r = found[stage]
        assert r.runs == 37 and r.mean_ms == pytest.approx(ms.mean(), abs=1e-3) and r.median_ms == pytest.approx(np.median(ms), abs=0.06) and r.p95_ms == pytest.approx(sorted(ms)[int(0.95 * 36)], abs=0.06)
    parts = P.breakdown(log).where("stage <> 'total'").groupBy("run").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in parts)


def test_a_profile_counts_rows_on_the_way(spark):
    timed = P.Profile(spark, "one", 5)
    rows = timed.stage("first", lambda: spark.range(70).toDF("a"))
    timed.stage("second", lambda: rows.where("a < 20"))
    assert [(r.stage, r.rows, r.queries, r.ms > 0) for r in timed.records().orderBy("place").collect()] == [("first", 70, 5, True), ("second", 20, 5, True)]


def test_places_in_a_group_that_holds_most_rows(spark):
    rows = [("hot", k % 211) for k in range(4000)] + [(f"g{k % 17}", k) for k in range(300)] + [("same", 1)] * 500
    table = spark.createDataFrame(rows, "g string, x int").repartition(9)
    found = ranks.placed(table, ["g"], ["x"]).collect()
    by = {}
    for r in found:
        by.setdefault(r.g, []).append((r.place, r.x))
    assert sum(map(len, by.values())) == len(rows)
    for g, got in by.items():
        assert [x for _, x in sorted(got)] == sorted(x for h, x in rows if h == g) and [p for p, _ in sorted(got)] == list(range(len(got)))
    assert ranks.placed(table.where("false"), ["g"], ["x"]).isEmpty()
