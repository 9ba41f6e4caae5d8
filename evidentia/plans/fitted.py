"""Queries that SQL cannot express: clusters, fitted models, chunks, IPv6, and windowed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.storage import written
from evidentia.operators import clusters, folds, logistic, retrieval, text
from evidentia.operators import judgement as J
from evidentia.plans import judged
from evidentia.streaming.score import event_windows

FEATURES = list(J.COEFFICIENTS)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, query_id, doc_id, grp, toxic, the standardised features) of every retrieved document with a label.

    The poisoned documents of a source are one group, as they are of one hand; every clean document is one of its own.
    """
    labels = _read(spark, sf_dir, "labels").where("toxic IN (0, 1)").select("doc_id", "toxic")
    sources = _read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = J.encoded(judged.signals(spark, sf_dir)).join(labels, "doc_id").join(sources, "doc_id")
    group = F.when(F.col("toxic") == 1, F.concat(F.lit("family:"), "source")).otherwise(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    rows = rows.select(F.concat_ws(":", "query_id", "doc_id").alias("row"), "query_id", "doc_id", group.alias("grp"), "toxic", *FEATURES)
    return written(logistic.standardised(rows, FEATURES), "training-rows")


def kmeans_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every fiftieth vector, clustered query by query."""
    every = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = every.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    hits = retrieval.nearest(every, asked, 10).join(every, "doc_id").select("query_id", "doc_id", "embedding")
    return clusters.cluster_anomaly(hits)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    every = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.nearest(every, every.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), retrieval.TOP)


def lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients at the chosen strength, and the calibration's intercept and slope."""
    rows = training_rows(spark, sf_dir)
    strength = logistic.choose_strength(rows, FEATURES, "toxic", "grp")
    one = logistic.weighted(rows, "toxic").withColumn("model", F.lit(0))
    beta = logistic.fit(one, FEATURES, {0: strength}).get(0, [0.0] * (1 + len(FEATURES)))
    intercept, slope = logistic.calibrate(rows, FEATURES, "toxic", "grp", strength)
    named = [*zip(["intercept", *FEATURES], beta, strict=True), ("platt_intercept", intercept), ("platt_slope", slope), ("strength", strength)]
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in named], "name string, value double")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every source among the labelled documents: whole sources, alike shares of poisoned documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = _read(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id")
    return folds.stratified_folds(rows, "source", "toxic").select(F.col("group").alias("grp"), "pos", "neg", "fold")


def fold_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold holds of the groups, of the rows and of the poisoned rows."""
    return group_split(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("groups"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.round(F.sum("pos") / F.sum(F.col("pos") + F.col("neg")), 6).alias("share"))


def calibrated_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each retrieved document with a label is poisoned, as the mean of the calibrated folds."""
    rows = training_rows(spark, sf_dir)
    found = logistic.probabilities(rows, FEATURES, logistic.calibrated(rows, FEATURES, "toxic", "grp", 1.0), "row")
    return found.join(rows.select("row", "query_id", "doc_id"), "row").select("query_id", "doc_id", F.round("p", 6).alias("p"))


def bootstrap_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of coefficients for each resample."""
    found = logistic.bootstrap(training_rows(spark, sf_dir), FEATURES, "toxic", "row", 1.0)
    schema = "resample int, intercept double, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame([(k, *(round(float(v), 6) for v in b)) for k, b in sorted(found.items())], schema)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(_read(spark, sf_dir, "documents"))


def entity_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ipv6(_read(spark, sf_dir, "documents"))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(_read(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (kmeans_anomaly, vector_topk, lr_fit, group_split, fold_shares, calibrated_risk, bootstrap_fit, chunks, entity_ipv6, events_hourly)}
# the groups one by one, with what the folds hold carried along
_TRIED = "list_stddev_pop(list_transform(w.{0}, lambda x, i: (x + CASE WHEN i = j THEN o.{1} ELSE 0 END) / greatest(t.{0}, 1e-300)))"
_FOLDS = f"""WITH RECURSIVE g AS (SELECT source AS grp, sum(toxic)::bigint AS pos, sum(1 - toxic)::bigint AS neg FROM labels JOIN documents USING (doc_id) WHERE toxic IN (0, 1) GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY abs(pos - neg) DESC, grp NULLS FIRST) AS nth FROM g), t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g),
walk AS (SELECT 0::bigint AS nth, [0, 0, 0, 0, 0]::double[] AS p, [0, 0, 0, 0, 0]::double[] AS n, NULL::varchar AS grp, 0::bigint AS pos, 0::bigint AS neg, 0::bigint AS best
  UNION ALL SELECT nth, list_transform(p, lambda x, i: x + CASE WHEN i = best THEN pos ELSE 0 END), list_transform(n, lambda x, i: x + CASE WHEN i = best THEN neg ELSE 0 END), grp, pos, neg, best
  FROM (SELECT o.nth, w.p, w.n, o.grp, o.pos, o.neg, list_sort(list_transform(range(1, 6), lambda j: {{'c': round(({_TRIED.format("n", "neg")} + {_TRIED.format("p", "pos")}) / 2, 12), 'r': w.p[j] + w.n[j], 'j': j}}))[1].j AS best FROM walk w JOIN o ON o.nth = w.nth + 1, t)),
f AS (SELECT grp, pos, neg, (best - 1)::int AS fold FROM walk WHERE nth > 0)"""
ORACLES = {"group_split": f"{_FOLDS} SELECT * FROM f", "fold_shares": f"{_FOLDS} SELECT fold, count(*) AS groups, sum(pos)::bigint AS pos, sum(neg)::bigint AS neg, round(sum(pos) / sum(pos + neg), 6) AS share FROM f GROUP BY fold", "vector_topk": "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::double[], d.embedding::double[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::double[], d.embedding::double[]), 6) DESC, d.vec_id)::int AS rnk FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rnk <= 5", "events_hourly": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"}
