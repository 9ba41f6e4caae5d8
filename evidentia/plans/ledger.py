"""The audit log: events as judged queries, and decisions on them.

events stand for the log of judged queries; every seventh and its successor carry a decision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.storage import written
from evidentia.operators import judgement as J
from evidentia.operators import ledger as L


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, query_id, created_at, k, action, tier, headline, subtype)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.when(F.col("event_type").isin("view", "purchase"), "ACCEPT").when(F.col("event_type") == "click", "REVIEW").when(F.col("event_type") == "signup", "REJECT").otherwise("ESCALATE")
    number = F.get_json_object("props", "$.k").cast("long")
    rows = rows.select("event_id", F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"), F.col("ts").alias("created_at"), number.alias("k"), action.alias("action"), (1 + F.col("user_id") % 3).alias("tier"))
    return rows.withColumns({"headline": J.headline(F.col("action"), F.col("tier")), "subtype": J.subtype(F.col("action"), F.col("tier"))})


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(decision_id, event_id, decision, ..., chain, seq): the second of two on one event corrects the first now and then."""
    n = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 7 < 2")
    override, reason = n % 5 == 0, F.when(n % 10 == 0, "INSUFFICIENT_EVIDENCE_TO_JUDGE").otherwise("OTHER")
    return rows.select(
        n.alias("decision_id"), (n - n % 7).alias("event_id"), F.when(override, "OVERRIDE").when(n % 2 == 0, "ACCEPT").otherwise("REJECT").alias("decision"), F.when(override, "REVIEW").alias("override_action"),
        F.when(override, reason).alias("reason_code"), F.when(override & (n % 3 > 0), F.concat(F.lit("seen by "), F.col("user_id").cast("string"))).alias("reason_text"), F.col("ts").alias("decided_at"),
        F.when((n % 7 == 1) & (n % 3 == 0), n - 1).alias("supersedes"), F.when(n % 13 == 0, "import").otherwise("analyst_ui").alias("decision_source"), F.to_date("ts").alias("chain"), n.alias("seq"),
    )


def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 red events with the decision that stands."""
    rows = L.listed(events(spark, sf_dir), decisions(spark, sf_dir), 50, headline="RED")
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("event_id"))))  # of 50 rows
    return placed.select("event_id", "headline", "subtype", "decision_id", "place")


def audit_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by filter: attacks that nobody looked at, attacks whose rejection stands, and whatever was overridden."""
    pages = {"unreviewed attacks": {"decision": "UNREVIEWED", "subtype": "ATTACK_DETECTED"}, "rejected attacks": {"decision": "REJECT", "subtype": "ATTACK_DETECTED", "headline": "RED"}, "overridden": {"decision": "OVERRIDE"}}
    shown = [L.listed(events(spark, sf_dir), decisions(spark, sf_dir), 100, **of).select(F.lit(name).alias("page"), "event_id", "headline", "subtype", "decision_id", "decision", "override_action", "reason_code") for name, of in pages.items()]
    return reduce(DataFrame.unionByName, shown)


def audit_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current(decisions(spark, sf_dir)).select("decision_id", F.col("event_id").alias("about"), "decision")


def audit_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decisions(spark, sf_dir).select("event_id").distinct()
    return events(spark, sf_dir).join(done, "event_id", "left_anti").groupBy("headline").agg(F.count("*").alias("n"))


def audit_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions that can be learned from, with their labels and what their events were."""
    rows = L.learnable(decisions(spark, sf_dir), events(spark, sf_dir))
    label = F.when(F.col("decision") == "REJECT", 1).when(F.col("decision") == "ACCEPT", 0)
    return rows.select("decision_id", "decision", "reason_code", "headline", "subtype", "action", "tier", label.alias("label"))


def decision_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why decisions may not be written; every eleventh is spoilt in one of four ways."""
    n, rows = F.col("decision_id"), decisions(spark, sf_dir)
    spoilt = (n % 11 == 0) & (n % 4 == 0), (n % 11 == 0) & (n % 4 == 1), (n % 11 == 0) & (n % 4 == 2), (n % 11 == 0) & (n % 4 == 3)
    rows = rows.withColumns({"decision": F.when(spoilt[0], "MAYBE").otherwise(F.col("decision")), "override_action": F.when(~spoilt[1], F.when(spoilt[2], "IGNORE").otherwise(F.col("override_action"))), "event_id": F.when(spoilt[3], -1).otherwise(F.col("event_id"))})
    return L.refusals(rows, events(spark, sf_dir))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions, written in two appends."""
    rows = decisions(spark, sf_dir)
    first = written(L.append(None, rows.where("hour(decided_at) < 12")), "ledger")
    return first.unionByName(written(L.append(first, rows.where("hour(decided_at) >= 12").withColumn("seq", F.col("seq") + (1 << 40))), "ledger"))


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's chains: rows, the last hash, and nothing wrong with them."""
    rows = L.verified(_ledger(spark, sf_dir))
    return rows.groupBy("chain").agg(F.count("*").alias("n"), F.count_if("edited").alias("edited"), F.count_if("unlinked").alias("unlinked"), F.max_by("row_hash", F.struct("seq", "decision_id")).alias("head"))


def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that was tampered with: an edited row, and one that is missing, show where they are."""
    rows = _ledger(spark, sf_dir)
    rows = rows.withColumn("decision", F.when(F.col("decision_id") % 1001 == 0, "EDITED").otherwise(F.col("decision"))).where("decision_id % 2002 <> 1")
    found = L.verified(rows).where("edited or unlinked")
    return found.select("chain", "decision_id", "edited", "unlinked")


QUERIES = {f.__name__: f for f in (audit_list, audit_list_filtered, audit_current, audit_pending, audit_labelled, decision_refusals, ledger_append, audit_chain_verify)}
