"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

A benchmark item is contained in a document where one of its windows (13 consecutive words, or the
whole item if it is shorter) occurs word for word.  A window is a set of placed shingles; containment
asks for all of them, so one shingle is a sufficient prefix: the rarest one.  Rarity is the number of
places in all documents.  A document's shingles are joined with the windows' shingles on a 64-bit
hash; the window's place follows from the shingle's, bounds on place and length drop what cannot fit,
and the words themselves are compared last.

Only the benchmark side is ever broadcast, and only while it has at most ``BROADCAST_WINDOWS``
windows; beyond that the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, document_key, stored

#: At most this many windows (and as many shingles each as a window has words) are broadcast.
BROADCAST_WINDOWS = 50_000
#: Ids of documents with candidates (128 bits each) that are broadcast; beyond that the join shuffles.
BROADCAST_DOCUMENTS = 200_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; none for null."""
    return F.coalesce(F.filter(F.split(ascii_lower(text), BETWEEN_WORDS), lambda w: w != ""), F.array().cast("array<string>"))


def _hash(w: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(w, i + k) for k in range(width)])


def _hashes(w: Column, width: int) -> Column:
    """The hashes of all runs of ``width`` words; null if there is none."""
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: _hash(w, i, width)))


def _occurrences(benchmark: DataFrame, window: int) -> DataFrame:
    """(window_id, words, item): every window with every item that has it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i") + 1, F.lit(window)).alias("words"))
    return each.select(F.unhex(F.md5(F.array_join("words", " "))).alias("window_id"), "words", "item").distinct()


def _windows(occurrences: DataFrame, shingle: int) -> DataFrame:
    """(window_id, words, width, shingles: (h, at)) for the distinct windows."""
    each = occurrences.select("window_id", "words").distinct()
    width = F.when(F.size("words") >= shingle, F.lit(shingle)).otherwise(F.lit(1))
    placed = F.transform(F.coalesce(_hashes(F.col("words"), shingle), _hashes(F.col("words"), 1)), lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return each.select("window_id", "words", width.alias("width"), placed.alias("shingles"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, hit_share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items with such
    windows; ``contaminated`` means ``n_hit > 0 and hit_share * n_hit >= n_words``.  Null and empty
    texts have no words and are clean; an item without words has no windows; an empty benchmark
    leaves every document clean.  Rows with the same doc_id and the same text are one document and
    each get its figures; a null doc_id is an id like any other.  Other columns are not looked at.
    """
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", document_key(F.col("doc_id"), F.col("text")))
    occurrences = stored(_occurrences(benchmark.select("item_id", F.col("text").cast("string").alias("text")), window), "occurrences")
    windows = stored(_windows(occurrences, shingle), "windows")
    small = F.broadcast if windows.count() <= BROADCAST_WINDOWS else (lambda df: df)
    widths = sorted(r.width for r in windows.select("width").distinct().collect())
    vocabulary = windows.select(F.explode("shingles.h").alias("h")).distinct()

    tokens = docs.select("key", words(F.col("text")).alias("w"))
    found = None
    for width in widths:
        part = tokens.select("key", F.posexplode(_hashes(F.col("w"), width)).alias("pos", "h")).join(small(vocabulary), "h", "left_semi")
        found = part if found is None else found.union(part)
    base = docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if found is None:
        result = base.select("key").where("false").withColumn("n_hit", F.lit(0))
        items = base.select("key").where("false").withColumn("items", F.array().cast("array<string>"))
    else:
        found = stored(found.distinct(), "places")
        rarity = found.groupBy("h").agg(F.count("*").alias("places"))
        ranked = windows.select("window_id", F.size("words").alias("length"), F.explode("shingles").alias("s")).select("window_id", "length", F.col("s.h").alias("h"), F.col("s.at").alias("at"))
        ranked = ranked.join(rarity, "h", "left").groupBy("window_id", "length").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "h", "at")).alias("prefix"))
        prefix = stored(ranked.where("prefix.places > 0").select("window_id", "length", F.col("prefix.h").alias("h"), F.col("prefix.at").alias("at")), "prefixes")
        placed = found.join(small(prefix), "h").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0").select("key", "start", "window_id", "length")
        spans = placed.join(small(windows.select("window_id", "words")), "window_id")
        spans = stored(spans.groupBy("key").agg(F.collect_set(F.struct("start", "length", "window_id", "words")).alias("spans")), "spans")
        keys = F.broadcast(spans.select("key")) if spans.count() <= BROADCAST_DOCUMENTS else spans.select("key")
        near = docs.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"]).join(spans, "key").select("key", "spans", words(F.col("text")).alias("w"))
        exact = F.filter("spans", lambda s: (s["start"] + s["length"] <= F.size("w")) & (F.slice(F.col("w"), s["start"] + 1, s["length"]) == s["words"]))
        near = stored(near.select("key", exact.alias("spans")).where("size(spans) > 0"), "hits")
        covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
        result = near.select("key", F.size(covered).alias("n_hit"))
        # only now the items, which may be many for a window that they share
        of_windows = near.select("key", F.explode(F.array_distinct("spans.window_id")).alias("window_id")).join(occurrences.select("window_id", "item"), "window_id")
        items = of_windows.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.join(result.join(items, "key", "left"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * hit_share >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest([w[i:i + least(len(w), 13) - 1] FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s.i AS i, s.win AS win FROM (SELECT doc_id, n, unnest([{'i': i, 'win': w[i:i + n - 1]} FOR i IN range(1, len(w) - n + 2)]) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
