"""Cut points of the signals as data: fitted on clean documents, saved, and joined into the rules.

A *cuts* column is a struct (suspicious, malicious, origin, unusable), each with one field a signal; a cut
point that is null belongs to a signal that cannot be used, which then counts for nothing in bands and cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.quantiles import quantiles

SIGNALS = ["unsupport", "anomaly", "injection", "conflict"]
# The quantiles of clean readings, how few readings are not fitted on and what stands in then,
# the declared cut points, and how flat readings may be.
SUSPICIOUS_Q, MALICIOUS_Q, FEW = 0.95, 0.99, 20
FALLBACK = (0.60, 0.85)
DECLARED = {"injection": (0.60, 0.90)}
FLAT = 1e-6
SCHEMA = "signal string, n long, suspicious double, malicious double, origin string, unusable string"


def fitted(readings: DataFrame) -> DataFrame:
    """(signal, n, suspicious, malicious, origin, unusable), one row for each of the four signals.

    ``readings`` has signal and v, the readings of clean documents only, as poisoned ones would raise the
    cut points that are to find them; null was not measured.  ``origin`` is declared, fallback (fewer
    than ``FEW`` readings) or fitted.  ``unusable`` says why a signal has no cut points: it was never read,
    or its clean readings are so flat, low or high that they would always or never fire.
    """
    every = readings.sparkSession.createDataFrame([(s, *DECLARED.get(s, (None, None))) for s in SIGNALS], "signal string, low double, high double")
    read = readings.where(F.col("v").isNotNull())
    of = read.groupBy("signal").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("spread"))
    q = quantiles(read, ["signal"], F.col("v"), (SUSPICIOUS_Q, MALICIOUS_Q)).groupBy("signal").agg(*[F.max(F.when(F.col("q") == at, F.col("value"))).alias(name) for name, at in (("q_low", SUSPICIOUS_Q), ("q_high", MALICIOUS_Q))])
    rows = every.join(of, "signal", "left").join(q, "signal", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    declared, few = F.col("low").isNotNull(), F.col("n") < FEW
    flat = (F.col("spread") < FLAT) | (F.col("q_low") <= FLAT) | (F.col("q_low") >= 1 - FLAT)
    why = F.when(declared, None).when(F.col("n") == 0, "never read").when(few, None).when(flat, F.when(F.col("q_low") <= FLAT, "flat: would always fire").otherwise("flat: would never fire"))
    fall = lambda i: F.when(few, F.lit(FALLBACK[i]))
    low = F.coalesce("low", fall(0), F.col("q_low"))
    high = F.coalesce("high", fall(1), F.when(F.col("q_high") <= F.col("q_low"), F.col("q_low") + 1e-6).otherwise(F.col("q_high")))
    rows = rows.withColumn("unusable", why)
    usable = lambda c: F.when(F.col("unusable").isNull(), F.round(c, 9))
    origin = F.when(declared, "declared").when(few, "fallback").otherwise("fitted")
    return rows.select("signal", "n", usable(low).alias("suspicious"), usable(high).alias("malicious"), origin.alias("origin"), "unusable")


KINDS = ("suspicious", "malicious", "origin", "unusable")


def cuts(thresholds: DataFrame) -> DataFrame:
    """One row with the column cuts."""
    of = lambda kind, s: F.max(F.when(F.col("signal") == s, F.col(kind))).alias(f"{kind}_{s}")
    row = thresholds.agg(*[of(kind, s) for kind in KINDS for s in SIGNALS])
    return row.select(F.struct(*[F.struct(*[F.col(f"{kind}_{s}").alias(s) for s in SIGNALS]).alias(kind) for kind in KINDS]).alias("cuts"))


def provisional() -> Column:
    """The cuts before any are fitted: the fallback, and the declared ones."""
    values = {"suspicious": lambda s: F.lit(DECLARED.get(s, FALLBACK)[0]), "malicious": lambda s: F.lit(DECLARED.get(s, FALLBACK)[1]), "origin": lambda s: F.lit("declared" if s in DECLARED else "fallback"), "unusable": lambda s: F.lit(None).cast("string")}
    return F.struct(*[F.struct(*[values[kind](s).alias(s) for s in SIGNALS]).alias(kind) for kind in KINDS])


def joined(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``rows`` with the cuts of ``thresholds`` beside each."""
    return rows.crossJoin(F.broadcast(cuts(thresholds)))  # one row


def save(thresholds: DataFrame, path: str) -> None:
    """Replaces the thresholds at ``path``."""
    thresholds.coalesce(1).write.mode("overwrite").json(path)  # four rows


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
