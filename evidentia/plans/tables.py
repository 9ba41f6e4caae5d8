"""The tables themselves: scans and keys, features, checks of quality, and what the audit log says of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import words as W
from evidentia.functions.storage import written
from evidentia.operators import signals as S
from evidentia.operators.quantiles import quantiles
from evidentia.operators.retrieval import hashed_vectors
from evidentia.plans import ledger
from evidentia.plans.judged import read

#: Sources 0 to 16 are registered; every fourth with another tier than the documents say.
REGISTERED = 17
#: Tiers that are reported, whether they have documents or not, and how many a tier needs.
TIERS, FLOOR = 4, 8
#: The words that a document should have at least and at most, and the languages that are known.
SHORT, LONG, LANGUAGES = 90, 420, ("en", "fr", "de", "es")
#: How many families of poisoned documents a manifest needs.
FAMILIES = 3
#: How many titles stand beside the benchmark's items.
TITLES = 30


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", "source", S.tier(F.col("source")).alias("source_tier"), F.trim(F.coalesce(text, F.lit(""))).alias("embedding_text"), F.sha2(text, 256).alias("content_sha256"))


def index_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the model's name and of all ids.

    The ids go in as sums of two parts of their hashes, which every task adds up for itself and whose order
    does not matter; none holds all ids.  Null ids are left out of the sums, and counted.
    """
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    sums = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select(F.substr(F.sha2(F.concat_ws("|", F.lit("hashing-384"), F.col("n").cast("string"), "a", "b"), 256), F.lit(1), F.lit(16)).alias("index_id"), "n")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items, and the first clean documents by id as titles."""
    clean = read(spark, sf_dir, "labels").where("toxic = 0").select("doc_id").distinct()
    titles = read(spark, sf_dir, "documents").select("doc_id", "text").join(clean, "doc_id", "left_semi").orderBy("doc_id", "text").limit(TITLES)
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit("target").alias("kind"))
    rows = asked.unionByName(titles.select(F.col("doc_id").alias("query_id"), "text", F.lit("title").alias("kind"))).withColumn("query_text", F.trim("text"))
    return rows.select("query_id", "query_text", F.sha2("query_text", 256).alias("query_hash"), "kind")


def template_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of five templates for each document, by the hash of its id."""
    number = F.conv(F.substr(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", (1 + number % 5).alias("variant"))


def doc_tokens_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", W.words(F.col("text")).alias("t"))
    distinct = F.array_distinct("t")
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(distinct).alias("n_distinct"), F.size(F.filter(distinct, lambda t: F.length(t) > 3)).alias("n_content"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit vectors of hashed features of all queries and documents, an entry a row."""
    queries, docs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), read(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = [hashed_vectors(rows).withColumn("kind", F.lit(kind)) for kind, rows in (("query", queries), ("document", docs))]
    return kinds[0].unionByName(kinds[1]).select("kind", F.col("doc_id").alias("id"), "idx", F.round("v", 6).alias("v"))


def feature_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each query has each pair of words, and each three characters of a word between marks."""
    t = W.words(F.col("text"))
    three = F.flatten(F.transform(t, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit("#"), w, F.lit("#")), i, F.lit(3)))))
    two = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.concat(a, F.lit("_"), b))
    named = lambda kind, grams: F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))
    grams = F.concat(named("trigram", three), F.when(F.size(t) > 1, named("bigram", two)).otherwise(F.array()))
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.inline(grams))
    return rows.groupBy("query_id", "kind", "gram").agg(F.count("*").alias("n"))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.lit(True).alias("document"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), F.lit(True).alias("label"))
    met = docs.join(labels, F.col("d") == F.col("l"), "full_outer").where("document is null or label is null")
    return met.select(F.coalesce("d", "l").alias("doc_id"), F.col("document").isNull().alias("missing_document"), F.col("label").isNull().alias("missing_label"))


def anomaly_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vector is from the mean of its label, and how odd that is by the label's median and spread.

    Medians are picked by ``quantiles``, as a label may hold most rows.  Null labels and vectors have no row.
    """
    rows = read(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    means = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("mean"))
    squared = lambda v, m: F.pow(v.cast("double") - m["m"], F.lit(2.0))
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "mean", squared), F.lit(0.0), lambda a, v: a + v))
    rows = written(rows.join(means, "label").select("vec_id", "label", far.alias("d")).withColumn("near", F.round("d", 8)), "distances")
    # unit vectors are at most 2 apart, and quantiles have their cells from 0 to 1
    middle = quantiles(rows, ["label"], F.col("near") / 2, [0.5]).select("label", (2 * F.col("value")).alias("m"))
    off = written(rows.join(middle, "label").withColumn("off", F.col("near") - F.col("m")), "deviations")
    spread = quantiles(off, ["label"], F.abs("off"), [0.5]).select("label", F.col("value").alias("mad"))
    z = F.when(F.col("mad") > 0, F.col("off") / (S.MAD_SCALE * F.col("mad"))).otherwise(0.0)
    return off.join(spread, "label").select("vec_id", F.round("d", 6).alias("distance"), F.round(S.squash(z), 6).alias("anomaly"))


def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, all and those with a label."""
    labelled = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")).distinct()
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    found = rows.groupBy("lang").agg(F.count("*").alias("before_n"), F.count("labelled").alias("k"))
    return found.select("lang", "before_n", F.when(F.col("k") > 0, F.col("k")).alias("after_n"), (F.col("before_n") != F.col("k")).alias("changed"))


def _long_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0)))


def _messages(*pairs: tuple[Column, str]) -> Column:
    """A row for each condition that holds."""
    return F.explode(F.array_compact(F.array(*[F.when(when, F.lit(message)) for when, message in pairs])))


def _issues(rows: DataFrame, severity: str = "error") -> DataFrame:
    return rows.select("doc_id", F.lit(severity).alias("severity"), "message")


def dq_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", _long_words(F.col("text")).alias("n"))
    return _issues(rows.select("doc_id", _messages((F.col("n") < SHORT, "short"), (F.col("n") > LONG, "long")).alias("message")), "warning")


def dq_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by tier, tiers without any as well; counted before they meet the tiers."""
    found = read(spark, sf_dir, "documents").groupBy(S.tier(F.col("source")).alias("tier")).agg(F.count("doc_id").alias("n"))
    tiers = spark.range(1, TIERS + 1).select(F.col("id").cast("int").alias("tier"))
    n = F.coalesce("n", F.lit(0))
    return tiers.join(found, "tier", "left").select("tier", n.alias("n"), (n < FLOOR).alias("below_floor"))


def dq_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by language in characters and in words; the median is the upper one, found among counts by length."""
    docs = read(spark, sf_dir, "documents").select("lang", "source", "n_chars", _long_words(F.coalesce("text", F.lit(""))).alias("words"))
    cells = docs.groupBy("lang", "source", "words").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("chars"), F.count("n_chars").alias("k"))
    every = Window.partitionBy("lang")
    upto = F.sum("n").over(every.orderBy("words", "source").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"upto": upto, "total": F.sum("n").over(every)})
    return cells.groupBy("lang").agg(
        F.min("least").alias("min_chars"), F.max("most").alias("max_chars"), F.round(F.try_divide(F.sum("chars"), F.sum("k")), 6).alias("mean_chars"), F.count_distinct("source").alias("sources"),
        F.min("words").alias("min_words"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("words"))).alias("median_words"), F.max("words").alias("max_words"),
    )


def dq_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source is not registered, or with another tier."""
    number = F.col("id").cast("int")
    registry = spark.range(REGISTERED).select(F.concat(F.lit("src"), number.cast("string")).alias("source"), (1 + (number + F.when(number % 4 == 0, 1).otherwise(0)) % 3).alias("tier"))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", S.tier(F.col("source")).alias("said")).join(F.broadcast(registry), "source", "left")  # REGISTERED rows
    return _issues(rows.select("doc_id", _messages((F.col("tier").isNull(), "source is not registered"), (F.col("tier") != F.col("said"), "tier differs from the registry")).alias("message")))


def dq_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels, labels without documents or with unknown values, and poisoned documents that are too much alike to learn from."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    unmet = manifest_diff(spark, sf_dir).select("doc_id", _messages((F.col("missing_label"), "no label"), (F.col("missing_document"), "label without a document")).alias("message"))
    unknown = labels.where("toxic is null or toxic not in (0, 1)").select("doc_id", F.lit("unknown label").alias("message"))
    poisoned = read(spark, sf_dir, "documents").select("doc_id", "source").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    spread = poisoned.agg(F.count_distinct("source").alias("families"), F.count_if(S.tier(F.col("source")) == 1).alias("first"))
    whole = spread.select(F.lit(None).cast("long").alias("doc_id"), _messages((F.col("families") < FAMILIES, "fewer than three families"), (F.col("first") == 0, "no poisoned document of tier 1")).alias("message"))
    return _issues(unmet.unionByName(unknown).unionByName(whole))


def dq_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text, lang = F.col("text"), F.col("lang")
    rows = docs.select("doc_id", _messages((text.isNull() | (F.trim(text) == ""), "empty text"), (F.length(text) != F.col("n_chars"), "length differs"), (lang.isNull() | ~lang.isin(*LANGUAGES), "unknown language")).alias("message"))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("repeated id").alias("message"))
    return _issues(rows.unionByName(repeated))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.events(spark, sf_dir).select("event_id", "query_id", "k", "action", "tier", "headline", "subtype")


def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a headline and its subtype contradict each other, and how often it is none of the three."""
    red = F.col("headline") == "RED"
    return ledger.events(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(red != F.col("subtype").isNotNull()).alias("red_breaks"), F.count_if(~F.col("headline").isin("RED", "ORANGE", "GREEN")).alias("enum_breaks"))


def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by headline, by action, and all; without events there is no row."""
    rows = ledger.events(spark, sf_dir)
    return rows.groupingSets([[F.col("headline")], [F.col("action")], []], "headline", "action").agg(F.count("*").alias("n"))


def audit_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was decided where which action was advised."""
    met = ledger.decisions(spark, sf_dir).select("event_id", "decision").join(ledger.events(spark, sf_dir).select("event_id", "action"), "event_id")
    return met.groupBy("action", "decision").agg(F.count("*").alias("n"))


def _verdicts(decisions: DataFrame) -> DataFrame:
    """(decision_id, place, verdict): what each decision says of the first three documents of its query."""
    rows = decisions.select("decision_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("place"))
    kind = (F.col("decision_id") + F.col("place")) % 3
    return rows.select("decision_id", "place", F.when(kind == 0, "POISONED").when(kind == 1, "CLEAN").otherwise("UNCERTAIN").alias("verdict"))


def audit_verdict_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(ledger.decisions(spark, sf_dir))


def audit_label_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from verdicts on documents where there are any, else a weak one from the decision; decisions that say nothing of the documents give none."""
    rows = ledger.decisions(spark, sf_dir).where("reason_code IS NULL OR reason_code NOT IN ('INSUFFICIENT_EVIDENCE_TO_JUDGE', 'POLICY_OVERRIDE')")
    strong = _verdicts(rows.where("decision_id % 2 = 0")).where("verdict <> 'UNCERTAIN'")
    strong = strong.select("decision_id", F.col("place").cast("long").alias("place"), (F.col("verdict") == "POISONED").cast("int").alias("label"), F.lit("verdict").alias("origin"))
    weak = rows.where("decision_id % 2 = 1 AND decision IN ('ACCEPT', 'REJECT')")
    return strong.unionByName(weak.select("decision_id", F.lit(None).cast("long").alias("place"), (F.col("decision") == "REJECT").cast("int").alias("label"), F.lit("weak").alias("origin")))


QUERIES = {
    f.__name__: f
    for f in (corpus_scan, index_id, query_set, template_variant, doc_tokens_profile, hash_embedding, feature_ngrams, manifest_diff, anomaly_centroid, metric_diff, dq_document, dq_tiers, dq_profile, dq_registry, dq_manifest, dq_required)
    + (audit_events, audit_checks, audit_stats, audit_agreement, audit_verdict_explode, audit_label_derivation)
}
