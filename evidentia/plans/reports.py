"""Reports on all benchmark items: their sentences, their documents, their text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import indicators as I
from evidentia.functions.storage import written
from evidentia.operators import events as E
from evidentia.operators import judgement as J
from evidentia.operators import report as P
from evidentia.operators import retrieval as R
from evidentia.operators import signals as S
from evidentia.operators import thresholds as T
from evidentia.operators.profile import Profile, breakdown
from evidentia.plans import judged

#: A report names its time; the registered queries have this one, so that they can be compared.
GENERATED_AT = "2026-01-01T00:00:00+00:00"


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged.cut_signals(spark, sf_dir)
    met = rows.select("query_id", F.explode("docs.doc_id").alias("doc_id")).join(judged.corpus(spark, sf_dir), "doc_id")
    found = met.select("query_id", F.explode(I.indicators(I.refang(F.col("text")))).alias("x")).groupBy("query_id").agg(F.count_distinct(F.struct("x.kind", F.lower("x.value"))).alias("n_entities"))
    out = J.scored(rows).join(judged.asked(spark, sf_dir).withColumnRenamed("text", "query"), "query_id").join(found, "query_id", "left")
    return written(P.reported(out.withColumn("n_entities", F.coalesce("n_entities", F.lit(0))), GENERATED_AT), "reports")


def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reported(spark, sf_dir).select("query_id", F.posexplode("sentences").alias("place", "s"))
    return rows.select("query_id", "place", "s.template_id", "s.text")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report by report what its JSON says, read back from it."""
    rows = _reported(spark, sf_dir).select("query_id", "report")
    said = lambda name: F.get_json_object("report", f"$.{name}")
    return rows.select("query_id", *[said(n).alias(n) for n in ("report_id", "headline", "case_id", "risk_tier", "action")], said("n_entities").cast("long").alias("n_entities"), F.json_array_length(said("docs")).alias("n_docs"), F.json_array_length(said("sentences")).alias("n_sentences"), F.json_array_length(said("caveats")).alias("n_caveats"))


def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that a report's sentences say, found again in the report by its pointer."""
    return P.resolved(_reported(spark, sf_dir))


def report_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each report how many facts it has, how many of those its JSON does not bear out, and how many numbers no fact says."""
    rows = _reported(spark, sf_dir)
    facts = P.resolved(rows).groupBy("query_id").agg(F.count("*").alias("n_facts"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
    return rows.select("query_id", F.size(P.ungrounded()).alias("n_ungrounded")).join(facts, "query_id")


def report_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir).select("query_id", F.posexplode("caveats").alias("place", "caveat"))


def audit_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log's event of every judged query, its structures as digests where SQL has no such type."""
    rows = E.recorded(_reported(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        "event_id", "created_at", "query_hash", joined("retrieved_doc_ids").alias("retrieved_doc_ids"), *[f"{s}_max" for s in J.SIGNALS], "d_conflict_max", "tier_governing", "tier_min", "n_retrieved", "n_eff", "band", "band_rule", "case_id", joined("all_matched_cases").alias("all_matched_cases"),
        F.array_join(F.transform("feature_vector", lambda f: F.concat_ws("/", f["is_tier1"].cast("string"), f["is_tier3"].cast("string"))), ",").alias("feature_tiers"), "taxonomy_action", "risk_score", "risk_p_upper", "trust_percent", "trust_low", "trust_high", "score_action", "confidence", "forced_review", "final_action",
        "risk_priority", "headline", "headline_subtype", "risk_tier", "entities", F.size("reasoning").alias("n_reasons"), "model_version", "taxonomy_version", F.element_at("detector_versions", "injection").alias("injection_version"), "backends_are_models", "is_verification_sample",
    )


def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long retrieval, signals, thresholds, judgement and reports take over all benchmark items, and for one of them."""
    docs, queries = judged.corpus(spark, sf_dir), judged.asked(spark, sf_dir)
    timed = Profile(spark, uuid.uuid4().hex, queries.count())
    top = timed.stage("retrieval", lambda: R.bm25_top(docs, queries, R.TOP))
    rows = timed.stage("signals", lambda: S.of_hits(top, docs, queries))
    cut = timed.stage("thresholds", lambda: T.joined(rows, judged.thresholds(spark, sf_dir, rows)))
    scored = timed.stage("judgement", lambda: J.scored(cut))
    timed.stage("report", lambda: P.reported(scored.join(queries.withColumnRenamed("text", "query"), "query_id").withColumn("n_entities", F.lit(0)), GENERATED_AT))
    return breakdown(timed.records()).drop("run")


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir).select("query_id", "report_id", P.markdown().alias("markdown"))


QUERIES = {f.__name__: f for f in (report_sentences, report_documents, report_facts, report_grounding, report_caveats, report_markdown, audit_recorded, latency_profile)}
