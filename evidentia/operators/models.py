"""Where models plug in, and what is kept of them: scores of pairs, answers, indexes, features, softmax."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """A number that is none was not measured."""
    return F.when(~F.isnan(c), c)


def softmax(values: Column) -> Column:
    """An array's exponentials as shares of their sum."""
    shifted = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def pair_scores(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 64) -> DataFrame:
    """``pairs`` (premise, claim, any others) with a model's ``score``.

    ``load`` is called once a Python worker and gives a function of two lists of texts.  Each distinct
    pair is scored once.  A pair with a null or blank text has a null score and never reaches the model.
    """
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    distinct = pairs.where(said("premise") & said("claim")).select("premise", "claim").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                yield part.assign(score=[float(x) for x in model(part["premise"].tolist(), part["claim"].tolist())])

    return pairs.join(distinct.mapInPandas(run, "premise string, claim string, score double"), ["premise", "claim"], "left")


def answer_key(query: Column, doc_ids: Column) -> Column:
    """What an answer is kept under: the query and the documents it was given, in their order."""
    return F.substr(F.sha2(F.concat(query, F.lit("|"), F.array_join(F.transform(doc_ids, lambda d: d.cast("string")), "|")), 256), F.lit(1), F.lit(32))


def cached_answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (query, doc_ids, any others) with key and the answer kept under it; null where there is none.

    Of several answers under one key the first in their order counts.
    """
    kept = cache.groupBy("key").agg(F.min("answer").alias("answer"))
    return requests.withColumn("key", answer_key(F.col("query"), F.col("doc_ids"))).join(kept, "key", "left")


def save_index(vectors: DataFrame, path: str, model: str) -> None:
    """Write ``vectors`` (doc_id, embedding) and, beside them, which model made them and how many."""
    stats = vectors.agg(F.lit(model).alias("model"), F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
    vectors.select("doc_id", "embedding").write.parquet(f"{path}/vectors")
    stats.write.parquet(f"{path}/about")


def load_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors of ``save_index``; another model's, or a part of them, is an error."""
    about = spark.read.parquet(f"{path}/about").first()
    if about.model != model:
        raise ValueError(f"the index was made by {about.model}, not by {model}; its scores mean nothing here")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.count() != about.n:
        raise ValueError("the index and what is said about it differ in their number of vectors")
    return vectors


def feature_ladder(available: list[str], positives: int, allowed: tuple[str, ...] = ("conflict",)) -> dict:
    """Which features so many positive rows can carry: signals that are allowed, and the tiers; by 60 and 150 rows."""
    signals = [s for s in ("unsupport", "anomaly", "injection", "conflict") if s in available and s in allowed]
    rung = "full" if positives >= 150 else "reduced" if positives >= 60 else "base_only"
    return {"rung": rung, "features": [f"x_{s}" for s in signals] + ["is_tier1", "is_tier3"], "underpowered": rung == "base_only"}


def placed(content: Column, payload: Column, placement: str) -> Column:
    """``content`` with a payload as its last paragraph (tail), between two in its middle (mid), or in two parts (split).

    A text of fewer than three paragraphs takes it at its end; a payload of one sentence is not split.
    """
    if placement not in ("tail", "mid", "split"):
        raise ValueError(f"no placement {placement}")
    paragraphs = F.filter(F.split(content, "\n\n"), lambda p: F.trim(p) != "")
    n = F.size(paragraphs)
    tail = F.concat(content, F.lit("\n\n"), payload, F.lit("\n"))
    joined = lambda parts: F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))
    put = lambda parts, at, text: F.concat(F.slice(parts, F.lit(1), at), F.array(text), F.slice(parts, at + 1, F.size(parts)))
    middle = joined(put(paragraphs, F.greatest(F.lit(1), F.floor(n / 2).cast("int")), payload))
    if placement == "tail":
        return tail
    if placement == "mid":
        return F.when(n < 3, tail).otherwise(middle)
    sentences = F.filter(F.transform(F.split(payload, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    half = F.floor(F.size(sentences) / 2).cast("int")
    first, second = F.array_join(F.slice(sentences, F.lit(1), half), " "), F.array_join(F.slice(sentences, half + 1, F.size(sentences)), " ")
    low = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    high = F.least(n, F.greatest(low + 2, F.floor(2 * n / 3).cast("int")))
    apart = joined(put(put(paragraphs, high, second), low, first))
    return F.when(n < 3, tail).when(F.size(sentences) < 2, middle).otherwise(apart)
