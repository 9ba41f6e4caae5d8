"""Judged queries as events of the audit log: every column, checked before it is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import judgement as J

# The versions that an event names, the bands, and which of them has a subtype.
TAXONOMY_VERSION = "design-v1.2"
HEADLINES = ["GREEN", "ORANGE", "RED"]


def recorded(rows: DataFrame, verification: bool = False) -> DataFrame:
    """The event of each ``report.reported`` row; its id follows from the query and the time, so that a repeated run has the same one.

    Lists and structures are arrays and structs, which Parquet keeps; null is what was not measured.
    """
    c = F.col
    ids = F.transform("docs", lambda d: d["doc_id"])
    used = F.sha2(F.to_json("cuts"), 256)
    return rows.select(
        F.concat(F.lit("evt-"), F.substr(F.sha2(F.concat("query", F.lit("|"), "generated_at"), 256), F.lit(1), F.lit(32))).alias("event_id"), c("generated_at").alias("created_at"), c("query").alias("query_text"), F.sha2("query", 256).alias("query_hash"),
        ids.alias("retrieved_doc_ids"), ids.alias("cited_doc_ids"), F.lit(None).cast("string").alias("generated_answer"), "docs", *[F.round(f"max_{s}", 6).alias(f"{s}_max") for s in J.SIGNALS], F.round("d_conflict_max", 6).alias("d_conflict_max"),
        F.transform("docs", lambda d: F.struct(F.round(J.clipped_logit(d["conflict"]), 6).alias("x_conflict"), (d["tier"] == 1).cast("int").alias("is_tier1"), (d["tier"] == 3).cast("int").alias("is_tier3"))).alias("feature_vector"),
        c("tier").alias("tier_governing"), F.array_max(F.transform("docs", lambda d: d["tier"])).alias("tier_min"), c("n_docs").alias("n_retrieved"), "n_eff", "band", c("rule").alias("band_rule"), "case_id", c("matched").alias("all_matched_cases"), c("case_action").alias("taxonomy_action"),
        c("risk").alias("risk_score"), c("risk_hi").alias("risk_p_upper"), c("trust").alias("trust_percent"), "trust_low", "trust_high", "score_action", "confidence", F.struct("volume", "agreement", "independence", "coherence", "stability").alias("confidence_components"), "forced_review",
        c("action").alias("final_action"), c("priority").alias("risk_priority"), "headline", c("subtype").alias("headline_subtype"), "risk_tier", c("n_entities").alias("entities"), c("sentences").alias("reasoning"), "caveats",
        F.when(c("model_fitted"), "published").otherwise("none").alias("model_version"), used.alias("threshold_set_version"), F.lit(TAXONOMY_VERSION).alias("taxonomy_version"), F.map_from_entries(F.transform("signals", lambda s: F.struct(s["signal"], s["backend"]))).alias("detector_versions"),
        (c("n_fallback") == 0).alias("backends_are_models"), F.lit(verification).alias("is_verification_sample"),
    )


def faults(events: DataFrame) -> DataFrame:
    """(event_id, fault): what an event may not be; several faults give several rows."""
    red = F.col("headline") == "RED"
    rules = {
        "no event id": F.col("event_id").isNull(), "no query": F.col("query_text").isNull(), "unknown headline": ~F.coalesce(F.col("headline").isin(HEADLINES), F.lit(False)),
        "red without subtype": red & F.col("headline_subtype").isNull(), "subtype without red": ~red & F.col("headline_subtype").isNotNull(),
        **{f"no {n}": F.col(n).isNull() for n in ("tier_governing", "n_eff", "case_id", "taxonomy_action", "score_action", "confidence", "final_action", "risk_priority")},
    }
    return events.select("event_id", F.explode(F.array_compact(F.array(*[F.when(when, fault) for fault, when in rules.items()]))).alias("fault"))


def append(events: DataFrame, path: str) -> DataFrame:
    """Appends events that are not in the log at ``path`` yet; faults of any are an error, and nothing is written then."""
    spark = events.sparkSession
    wrong = faults(events).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.event_id}: {r.fault}" for r in wrong))
    known = read(spark, path)
    fresh = events.dropDuplicates(["event_id"])
    if known is not None:
        fresh = fresh.join(known.select("event_id"), "event_id", "left_anti").select(*events.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All events of the log; None before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
