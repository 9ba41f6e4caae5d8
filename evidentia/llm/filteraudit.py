"""How filters interact: every order of them, run as a trie over persisted survivors.

Each filter is judged once for each document.  Then the orders are walked depth first: a state is the
set of filters that were applied so far, and its survivors are a DataFrame made from its parent's by
one filter and persisted.  Orders that reach the same set in another sequence have the same survivors,
so a state is executed once and its counts are remembered; an edge (state, next filter) counts what
that filter really removes from the survivors.  With n filters there are 2**n states and n * 2**(n-1)
edges in place of n! * n steps.  Only the states on the way down are persisted, n at most at a time,
each as a few bytes a document; a lost executor's part is computed again from the written judgements.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.storage import owned

from .shared import stored

#: What separates words.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
#: op12's filters that look at a text alone, as conditions of failure; E looks at the table.
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 200, 50, 3, "[#$%&*|]"
COUNTED = ("removed", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure by filter: A few words, B words that repeat, C capitals, D symbols."""
    words = F.filter(F.split(text, BETWEEN_WORDS, -1), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < FEW_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_SHARE * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, A, B, C, D, E) of every row of ``docs`` (doc_id, text, lang), written.

    E fails a text that equals that of a smaller doc_id anywhere in the table.  The first document of each text is
    found by a pre-aggregated minimum and met again by digest and id together, so that a text with many
    copies is no task of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(f) for f, c in text_failures(text).items()])
    each = stored(each, "failures")
    firsts = each.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    of = of.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id have no smaller id and no label, and stay out of the joins
    named = each.where("doc_id is not null").join(firsts, ["digest", "doc_id"], "left").join(of, "doc_id", "left")
    named = named.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), *"ABCD", F.col("first").isNull().alias("E"))
    other = each.where("doc_id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), *"ABCD", F.lit(False).alias("E"))
    return stored(named.unionByName(other), "judged")


class Trie:
    """Depth-first execution of all orders of ``filters`` over ``rows`` (part, good, toxic, a boolean a filter: it fails).

    ``edges`` gathers (part, state, filter, kept, removed, good_lost, toxic_lost) of every edge in Parquet;
    a state is the sum of its filters' bits."""

    def __init__(self, rows: DataFrame, filters: str):
        self.rows, self.filters = rows, filters
        self.path = owned(rows.sparkSession, "edges")
        self.executed: set[int] = set()

    def bit(self, name: str) -> int:
        return 1 << self.filters.index(name)

    def run(self) -> DataFrame:
        self._walk(0, self.rows)
        return self.rows.sparkSession.read.parquet(self.path)

    def _walk(self, state: int, survivors: DataFrame) -> None:
        """Goes down from a state, unless another sequence of the same filters was there before."""
        left = [f for f in self.filters if not state & self.bit(f)]
        if state in self.executed or not left:
            return
        self.executed.add(state)
        if state:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        self._count(state, left, survivors)
        for name in left:
            self._walk(state | self.bit(name), survivors.where(~F.col(name)))
        if state:
            survivors.unpersist()

    def _count(self, state: int, left: list[str], survivors: DataFrame) -> None:
        """One pass over a state's survivors counts all edges that leave it."""
        hit = {"removed": F.lit(True), "good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
        sums = [F.count("*").alias("n"), *[F.count_if(F.col(f) & when).alias(f"{f}_{name}") for f in left for name, when in hit.items()]]
        per = survivors.groupBy("part").agg(*sums)
        edges = F.array(*[F.struct(F.lit(f).alias("filter"), (F.col("n") - F.col(f"{f}_removed")).alias("kept"), *[F.col(f"{f}_{name}").alias(name) for name in hit]) for f in left])
        per.select("part", F.lit(state).alias("state"), F.inline(edges)).write.mode("append").parquet(self.path)


def orders(filters: str) -> Iterator[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, state before it) of every step of every order."""
    for order in permutations(filters):
        state = 0
        for step, name in enumerate(order, 1):
            yield "".join(order), step, name, state
            state |= 1 << filters.index(name)


def audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; ``filters`` picks some of A to E.  A part is a lang, null
    and the empty text being one.  A null text counts as the empty one.  Repeated rows are documents of
    their own, and none of them is smaller than another; a null doc_id is not smaller than any and has
    none smaller.  A document is good or toxic if any label of its doc_id says so.  Without documents
    there are no rows.  Other columns are not looked at.
    """
    return steps_of(Trie(judged(docs, labels), filters).run(), filters)


def steps_of(edges: DataFrame, filters: str) -> DataFrame:
    """The counts of all steps of all orders, from those of the trie's edges."""
    n = len(filters)
    # an edge out of a state of k filters is taken by k! * (n - 1 - k)! orders
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (F.bit_count("state") + 1).cast("int"))
    own = F.element_at(F.create_map(*[x for k, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << k))]), F.col("filter"))
    of = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("state") + own == (1 << n) - 1, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"),
    )
    plan = edges.sparkSession.createDataFrame(list(orders(filters)), "filter_order string, step int, filter string, state int")
    grid = of.join(F.broadcast(plan), "filter")  # n! * n rows, whatever the input
    out = grid.join(edges, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("part", "filter_order", "step", "fails", *[zero(c) for c in ("kept", *COUNTED)], F.col("unique_fails").cast("long").alias("unique_fails"), F.col("shapley").cast("long").alias("shapley"))
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS tox FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(tox, false) AS tox, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < w.doc_id, false)] AS x FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (tox) AS t FROM f GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, i AS step, o[i] AS me, o[1:i - 1] AS before FROM p, i),
c AS (SELECT part, filter_order, step, me, sum(n) FILTER (NOT x[me] AND NOT gone) AS kept, sum(n) FILTER (x[me] AND NOT gone) AS removed, sum(n) FILTER (x[me] AND gone) AS redundant,
  sum(n) FILTER (x[me] AND len(list_filter(x, lambda b: b)) = 1) AS unique_fails, sum(g) FILTER (x[me] AND NOT gone) AS good_lost, sum(t) FILTER (x[me] AND NOT gone) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda k: x[k])) > 0 AS gone FROM m, s) GROUP BY ALL)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
  coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, me))::bigint AS shapley FROM c
"""
