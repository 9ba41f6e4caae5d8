"""A chain is extended by one stream, however adaptive execution reads the shuffle under it."""

from pyspark.sql import functions as F

from evidentia.functions.storage import written
from evidentia.operators import ledger as L


def test_chains_hold_when_the_heads_turn_out_small(spark):
    n = F.col("id")
    rows = spark.range(0, 4000, 1, 8).select(
        n.alias("decision_id"), n.alias("event_id"), F.lit("ACCEPT").alias("decision"), *[F.lit(None).cast("string").alias(c) for c in ("override_action", "reason_code", "reason_text")],
        F.lit("2024-01-01").alias("decided_at"), F.lit(None).cast("long").alias("supersedes"), F.lit("import").alias("decision_source"), (n % 3).alias("chain"), n.alias("seq"),
    )
    # planned as a merge join, as a long ledger is, and made a broadcast join once its heads are counted
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        first = written(L.append(None, rows.where("decision_id < 2000")), "first")
        last = {r.chain: r.h for r in first.groupBy("chain").agg(F.max_by("row_hash", "seq").alias("h")).collect()}
        found = sorted(L.append(first, rows.where("decision_id % 4 > 1 AND decision_id >= 2000")).collect(), key=lambda r: r.seq)
        assert len(found) == 1000
        for r in found:
            assert r.prev_row_hash == last[r.chain]
            last[r.chain] = r.row_hash
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
