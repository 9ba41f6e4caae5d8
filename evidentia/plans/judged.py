"""Retrieval, signals, cases and judgement over the engine's tables.

documents stand for the corpus, benchmark items for the queries.  The checking SQL is written on its
own in ``judged_sql``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import words as W
from evidentia.functions.storage import written
from evidentia.operators import judgement as J
from evidentia.operators import report as P
from evidentia.operators import retrieval as R
from evidentia.operators import signals as S
from evidentia.operators import thresholds as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_top(corpus(spark, sf_dir), asked(spark, sf_dir), R.TOP)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of each query, written, as what follows reads them more than once."""
    return written(S.measured(corpus(spark, sf_dir), asked(spark, sf_dir)), "signals")


def thresholds(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The cut points that the readings of clean documents among ``rows`` (see ``signals``) give, written."""
    clean = read(spark, sf_dir, "labels").where("toxic = 0").select("doc_id").distinct()
    docs = rows.select(F.explode("docs").alias("d")).select("d.*").join(clean, "doc_id", "left_semi")
    return written(T.fitted(docs.unpivot(["doc_id"], J.SIGNALS, "signal", "v")), "thresholds")


def cut_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals`` with the cuts that are fitted on them."""
    rows = signals(spark, sf_dir)
    return T.joined(rows, thresholds(spark, sf_dir, rows))


def each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each query and document."""
    return S.measured(corpus(spark, sf_dir), asked(spark, sf_dir)).select("query_id", F.explode("docs").alias("d")).select("query_id", "d.*")


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "doc_id", "score", "rnk")


def target_doc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each query's first document of the lowest tier stands, and its best competitor's score.

    A rank is one more than the number of scores that come before, so they are counted and not sorted."""
    rows = corpus(spark, sf_dir).select("doc_id", "text", S.tier(F.col("source")).alias("tier"))
    place = F.struct((-F.col("score")).alias("below"), "doc_id")
    out = []
    for scores in R.scored(rows, asked(spark, sf_dir)):
        firsts = reduce(DataFrame.unionByName, [scores.best(1, when, "tier") for when in ("tier = 3", "tier <> 3", "tier is null")])
        best = firsts.groupBy("query_id").agg(F.min(place)["doc_id"].alias("best_doc"), F.min(F.when(F.col("tier") == 3, place)).alias("target"), F.max(F.when(F.col("tier") != 3, F.col("score"))).alias("top_competitor"))
        best = written(best, "best")
        rank = scores.every("tier").join(best.select("query_id", "target"), "query_id").groupBy("query_id").agg(F.count_if(place < F.col("target")).alias("before"))
        out.append(best.join(rank, "query_id").select("query_id", "best_doc", F.when(F.col("target").isNotNull(), F.col("before") + 1).cast("int").alias("target_rank"), "top_competitor"))
    return reduce(DataFrame.unionByName, out)


def retrieval_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log keeps of a query: scores, tiers, and the ids in rank order."""
    docs = corpus(spark, sf_dir).select("doc_id", S.tier(F.col("source")).alias("tier"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rnk", "doc_id"))), lambda h: h["doc_id"].cast("string"))
    return hits(spark, sf_dir).join(docs, "doc_id").groupBy("query_id").agg(
        F.count("*").alias("n_retrieved"), F.max("score").alias("similarity_top"), F.min("score").alias("similarity_min"), F.round(F.max("score") - F.min("score"), 6).alias("similarity_spread"),
        F.max("tier").alias("tier_min"), F.min_by("tier", "rnk").alias("top_tier"), F.array_join(ids, ",").alias("doc_ids"),
    )


def label_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).join(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").join(corpus(spark, sf_dir).drop("text"), "doc_id")
    group = F.when(F.col("label") == 1, F.concat(F.lit("family:"), "source")).otherwise(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return rows.select("query_id", "doc_id", "rnk", "label", group.alias("grp"))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    poisoned = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return hits(spark, sf_dir).join(poisoned, "doc_id", "left_semi").agg(F.count_distinct("query_id").alias("targets_reached"), F.count_distinct("doc_id").alias("poisoned_retrieved"))


def salient_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that an attacker would write for a query: its subject, and its first six terms."""
    topics = F.array_join(F.slice(W.salient_terms(F.col("text")), 1, 6), ", ")
    return asked(spark, sf_dir).select("query_id", F.concat(F.lit("This item addresses "), W.subject(F.col("text")), F.lit(". It is filed against the following topics: "), topics, F.lit(".")).alias("segment"))


def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir).select("query_id", "doc_id", *six("entailment", "unsupport"), F.round(1 - F.col("entailment"), 6).alias("neutral"))


def pairwise_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.classified(signals(spark, sf_dir)).where("n_docs > 1")
    return out.select("query_id", *six("d_conflict_max"), F.round("tier1_conflict", 6).alias("tier1_conflict_max"), (F.col("n_docs") * (F.col("n_docs") - 1) / 2).cast("long").alias("n_pairs"))


def doc_conflict_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir).select("query_id", "doc_id", *six("conflict"))


def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir).select("query_id", "doc_id", F.col("cluster").cast("long").alias("cluster"), "distance", F.round("anomaly_z", 6).alias("z"), *six("anomaly"))


def fit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut points of the signals, and why one has none."""
    return thresholds(spark, sf_dir, signals(spark, sf_dir)).select("signal", "n", *six("suspicious", "malicious"), "origin", "unusable")


def _each_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each query and document, with the cuts."""
    return cut_signals(spark, sf_dir).select("query_id", "cuts", F.explode("docs").alias("d")).select("query_id", "cuts", "d.*")


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {s: F.col(s) for s in J.SIGNALS}
    return _each_cut(spark, sf_dir).select("query_id", "doc_id", "tier", J.band(values, F.col("cuts")).alias("band"), J.rule(values, F.col("cuts")).alias("rule"))


def assign_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of every retrieved document on its own, and the rule that gave it."""
    return _banded(spark, sf_dir).select("query_id", "doc_id", "band", "rule")


def case_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many retrieved documents are in each tier and band, and the case that this is."""
    rows = _banded(spark, sf_dir).groupBy("tier", "band").agg(F.count("*").alias("n")).withColumn("case_id", J.grid_case(F.col("tier"), F.col("band")))
    return rows.select("tier", "band", "n", "case_id", *[J.case_field(F.col("case_id"), f).alias(f) for f in ("priority", "action")])


def response_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides a response's case beside its band."""
    out = J.classified(cut_signals(spark, sf_dir))
    return out.select("query_id", "tier", "band", "rule", *six("n_eff", "tier1_conflict"), "support", "outliers", F.array_join("matched", ",").alias("matched"), "case_id", J.case_field(F.col("case_id"), "action").alias("case_action"))


def classify_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.classified(cut_signals(spark, sf_dir))
    return out.select("query_id", "tier", "band", F.array_join("matched", ",").alias("matched"), "case_id", *[J.case_field(F.col("case_id"), f).alias(f) for f in ("priority", "action")])


def signal_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading against the two cut points of its signal; one without cut points is not usable."""
    long = _each_cut(spark, sf_dir).unpivot(["query_id", "doc_id", "cuts"], J.SIGNALS, "signal", "v")
    cut = lambda kind: F.coalesce(*[F.when(F.col("signal") == s, F.col("cuts")[kind][s]) for s in J.SIGNALS])
    sus, mal = cut("suspicious"), cut("malicious")
    status = F.when(F.col("v").isNull(), "missing").when(mal.isNull(), "unusable").when(F.col("v") >= mal, "over_malicious").when(F.col("v") >= sus, "over_suspicious").otherwise("below")
    return long.select("query_id", "doc_id", "signal", status.alias("status"), F.round(F.col("v") - sus, 6).alias("margin_suspicious"), F.round(F.col("v") - mal, 6).alias("margin_malicious"))


def encode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.encoded(S.measured(corpus(spark, sf_dir), asked(spark, sf_dir))).select("query_id", "doc_id", *six("x_conflict"), "is_tier1", "is_tier3")


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.standardised(J.encoded(signals(spark, sf_dir)), list(J.COEFFICIENTS)).select("query_id", "doc_id", *six(*J.COEFFICIENTS))


def risk_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.risks(J.standardised(J.encoded(signals(spark, sf_dir)), list(J.COEFFICIENTS)))
    return out.select("query_id", "doc_id", *six("risk", "risk_lo", "risk_hi"), F.round(100 * (1 - F.col("risk")), 2).alias("trust_percent"))


def n_eff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.classified(signals(spark, sf_dir)).select("query_id", "n_sources", *six("n_eff"))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.scored(cut_signals(spark, sf_dir)).select("query_id", *six("volume", "agreement", "independence", "coherence", "stability"), "confidence", "forced_review")


def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item retrieved and judged: case, risk with interval, confidence, action, headline."""
    out = J.scored(cut_signals(spark, sf_dir))
    return out.select(
        "query_id", "tier", "band", F.array_join("matched", ",").alias("matched"), "case_id", "priority", "case_action", "score_action", "action", "headline", "subtype",
        *six("risk", "risk_lo", "risk_hi"), F.round(100 * (1 - F.col("risk")), 2).alias("trust_percent"), "confidence", "forced_review", F.round("n_eff", 4).alias("n_eff"), "n_docs",
    )


def dominance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which actions cases and score asked for together, and what was done: the severer one, or more for want of confidence."""
    rows = J.scored(cut_signals(spark, sf_dir)).groupBy("case_action", "score_action", "forced_review", "action").agg(F.count("*").alias("n"))
    return rows.select("case_action", "score_action", "forced_review", J.dominant(F.col("case_action"), F.col("score_action")).alias("severer"), "action", "n")


def headline_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.scored(cut_signals(spark, sf_dir)).groupBy("action", "tier", "headline", "subtype").agg(F.count("*").alias("n"))


def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.scored(cut_signals(spark, sf_dir)).groupBy("priority", "action").agg(F.count("*").alias("n"))
    return rows.select("priority", "action", P.risk_tier(F.col("priority"), F.col("action")).alias("risk_tier"), "n")


def score_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the upper bound of a query's risk asks for, with consistent bands and without."""
    worst = J.worst_risk(J.risks(J.standardised(J.encoded(signals(spark, sf_dir)), list(J.COEFFICIENTS))))
    return worst.select("query_id", *six("risk_hi"), *[J.score_action(F.col("risk_hi"), F.lit(ok)).alias(name) for ok, name in ((True, "three_band"), (False, "review_only"))])


#: Characters of evidence that a prompt holds.
PROMPT_CHARS = 6000


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, blocks, prompt): the documents in rank order until one would break the budget, then the question."""
    docs = corpus(spark, sf_dir).withColumn("tier", S.tier(F.col("source")))
    rows = hits(spark, sf_dir).join(docs, "doc_id")
    block = F.concat(F.lit("["), F.col("rnk").cast("string"), F.lit("] document "), F.col("doc_id").cast("string"), F.lit(", tier "), F.col("tier").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    used = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.select("query_id", "rnk", block.alias("block")).withColumn("used", used).where(F.col("used") <= PROMPT_CHARS)
    joined = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "block"))).alias("blocks"))
    question = F.concat(F.lit("Answer from the documents and name them.\n\n"), F.array_join("blocks.block", ""), F.lit("Question: "), F.col("text"))
    return asked(spark, sf_dir).join(joined, "query_id", "left").select("query_id", F.coalesce(F.size("blocks"), F.lit(0)).alias("n_blocks"), F.when(F.col("blocks").isNotNull(), question).otherwise(F.concat(F.lit("Answer without documents.\n\nQuestion: "), F.col("text"))).alias("prompt"))


def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("query_id", "n_blocks", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of the first three documents; documents have no summary, so 300 characters stand for it."""
    rows = hits(spark, sf_dir).where("rnk <= 3").join(corpus(spark, sf_dir), "doc_id").select("query_id", F.struct("rnk", F.substr("text", F.lit(1), F.lit(300)).alias("t")).alias("p"))
    return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["t"], " ").alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, target_doc_rank, retrieval_log_summary, label_attach, reachability, salient_terms, claim_coverage, pairwise_conflict, doc_conflict_max, robust_z, fit_bands, assign_band, case_grid, response_cases,
        classify_response, signal_readings, encode_features, standardize, risk_interval, n_eff, confidence, score_query, dominance_matrix, headline_truth_table, risk_tier, score_action, prompt_budget, extractive_answer,
    )
}
