"""The four signals of every retrieved document, one row for each query.

A query's hits are few (``retrieval.TOP``), so they stand in one array and everything that compares
them is an expression over it; only retrieval and vectors need joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import words as W
from evidentia.functions.storage import written
from evidentia.operators.retrieval import TOP, bm25_top, hashed_vectors

# What makes the median of deviations a standard deviation, and how fast a z fades.
MAD_SCALE, FADE = 1.4826, 2.0
#: Places of a reading, so that equal ones are equal whatever order their sums had.
SIX = 6


def tier(source: Column) -> Column:
    """Sources stand for registered ones: their number tells the tier."""
    return 1 + F.substr(source, F.lit(4)).cast("int") % 3


def median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2


def robust_z(values: Column) -> Column:
    """Distances from the median in scaled medians of them; 0 where nothing is spread, or for one value."""
    mid = median(values)
    spread = MAD_SCALE * median(F.transform(values, lambda v: F.abs(v - mid)))
    return F.transform(values, lambda v: F.when((F.size(values) > 1) & (spread > 0), (v - mid) / spread).otherwise(0.0))


def squash(z: Column) -> Column:
    return 1 - F.exp(-F.greatest(z, F.lit(0.0)) / FADE)


#: So many hits of a query are split in two clusters; below, all are one.
CLUSTERED = 4


def gram(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, gram): the inner products (i, j, g) of a query's hits, i <= j being their ranks; 0 where there is no entry.

    ``hits`` has query_id, doc_id and rnk.  Products are summed by query and pair, of which few hits make few.
    """
    met = hits.select("query_id", "doc_id", "rnk").join(vectors, "doc_id")
    cells = met.groupBy("query_id", "idx").agg(F.array_sort(F.collect_list(F.struct("rnk", "v"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["rnk"] >= a["rnk"]), lambda b: F.struct(a["rnk"].alias("i"), b["rnk"].alias("j"), (a["v"] * b["v"]).alias("p")))))
    sums = cells.select("query_id", F.inline(pairs)).groupBy("query_id", "i", "j").agg(F.sum("p").alias("g"))
    return sums.groupBy("query_id").agg(F.collect_list(F.struct("i", "j", "g")).alias("gram"))


def _side(mask: Column, rank: Column) -> Column:
    return F.try_mod(F.floor(mask / F.pow(F.lit(2.0), rank - 1)), F.lit(2)).cast("int")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def clusters(n: Column, gram: Column) -> Column:
    """The split of ``n`` hits in two clusters with the least sum of squared distances to their means, exactly: bit
    r - 1 of it is the cluster of rank r.

    All splits are tried (15 for five hits), from the inner products alone: a cluster's sum is that of its
    squares less the sum of all its products over its size.  Fewer than ``CLUSTERED`` hits are one cluster.  Of equal splits
    (to nine places) the smallest number counts.
    """
    squares = _sum(F.transform(F.filter(gram, lambda e: e["i"] == e["j"]), lambda e: e["g"]))

    def cost(mask: Column) -> Column:
        size = lambda side: F.when(side == 1, F.bit_count(mask)).otherwise(n - F.bit_count(mask))
        inside = F.filter(gram, lambda e: _side(mask, e["i"]) == _side(mask, e["j"]))
        return squares - _sum(F.transform(inside, lambda e: F.when(e["i"] == e["j"], e["g"]).otherwise(2 * e["g"]) / size(_side(mask, e["i"]))))

    splits = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n - 1) - 1)
    best = F.array_min(F.transform(splits, lambda m: F.struct(F.round(cost(m), 9).alias("cost"), m.alias("mask"))))["mask"]
    return F.when(n < CLUSTERED, F.lit(0)).otherwise(best)


def distances(n: Column, gram: Column, mask: Column) -> Column:
    """How far each hit, in rank order, is from the mean of its cluster, to six places."""

    def one(r: Column) -> Column:
        mine = lambda k: _side(mask, k) == _side(mask, r)
        size = F.when(_side(mask, r) == 1, F.bit_count(mask)).otherwise(n - F.bit_count(mask))
        own = _sum(F.transform(F.filter(gram, lambda e: (e["i"] == r) & (e["j"] == r)), lambda e: e["g"]))
        among = F.filter(gram, lambda e: mine(e["i"]) & mine(e["j"]))
        to = _sum(F.transform(F.filter(among, lambda e: (e["i"] == r) | (e["j"] == r)), lambda e: e["g"]))
        every = _sum(F.transform(among, lambda e: F.when(e["i"] == e["j"], e["g"]).otherwise(2 * e["g"])))
        return F.round(F.sqrt(F.greatest(F.round(own - 2 * to / size + every / (size * size), 10), F.lit(0.0))), 6)

    return F.transform(F.sequence(F.lit(1), n), one)


def conflicts(hits: Column) -> Column:
    """For each hit the largest difference of support from another one; null for a hit that is alone."""
    return F.transform(hits, lambda a: F.array_max(F.transform(F.filter(hits, lambda b: b["rnk"] != a["rnk"]), lambda b: F.abs(a["entailment"] - b["entailment"]))))


def measured(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, docs): the retrieved documents of each query in rank order.

    Each has rnk, doc_id, score, source, tier, entailment, unsupport, cluster, distance, anomaly_z, anomaly,
    injection and conflict.  ``docs`` has doc_id, text and source, ``queries`` query_id and text.
    Queries that retrieve nothing have no row.
    """
    return of_hits(bm25_top(docs, queries, TOP), docs, queries)


def of_hits(top: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``measured`` for hits (query_id, doc_id, score, rnk) that are found already."""
    hits = top.join(docs, "doc_id").join(queries.select("query_id", F.col("text").alias("claim")), "query_id")
    hits = hits.select(
        "query_id", "doc_id", "rnk", "score", "source", tier(F.col("source")).alias("tier"), F.col("text"), F.round(W.coverage(F.col("text"), F.col("claim")), SIX).alias("entailment"),
        F.round(W.noisy_or(W.injection_hits(F.col("text"))), SIX).alias("injection"),
    )
    hits = written(hits, "hits")
    vectors = hashed_vectors(hits.select("doc_id", "text").dropDuplicates(["doc_id"]))
    row = F.struct("rnk", "doc_id", "score", "source", "tier", "entailment", "injection")
    out = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits")).join(gram(hits, vectors), "query_id", "left")
    # written, so that each step is computed once a query and not once a use
    out = out.withColumns({"n": F.size("hits"), "gram": F.coalesce("gram", F.array().cast("array<struct<i: int, j: int, g: double>>"))}).withColumn("mask", clusters(F.col("n"), F.col("gram")))
    out = written(out.withColumn("distance", distances(F.col("n"), F.col("gram"), F.col("mask"))), "clusters")
    out = out.withColumns({"z": robust_z(F.col("distance")), "conflict": conflicts(F.col("hits"))})
    fields = lambda d, i: F.struct(
        d["rnk"].alias("rnk"), d["doc_id"].alias("doc_id"), d["score"].alias("score"), d["source"].alias("source"), d["tier"].alias("tier"), d["entailment"].alias("entailment"),
        F.round(1 - d["entailment"], SIX).alias("unsupport"), _side(F.col("mask"), i + 1).alias("cluster"), F.get("distance", i).alias("distance"), F.get("z", i).alias("anomaly_z"), F.round(squash(F.get("z", i)), SIX).alias("anomaly"), d["injection"].alias("injection"), F.round(F.get("conflict", i), SIX).alias("conflict"),
    )
    return out.select("query_id", F.transform("hits", fields).alias("docs"))
