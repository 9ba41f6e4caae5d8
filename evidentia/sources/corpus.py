"""Readers and writers of corpus documents, registries, query files and the retrieval log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields that an index may see, and those that give an evaluation's answers away.
ALLOWED = (
    "doc_id", "source_id", "source_name", "source_tier", "source_tier_label", "source_type", "publisher", "title", "summary", "content", "content_sha256", "content_word_count",
    "ingestion_date", "published_date", "reference_url", "reference_verified", "tags", "cve_ids", "attack_techniques", "healthcare_relevance", "vendor", "product", "attestation",
)
FORBIDDEN = ("label", "ground_truth", "is_poisoned", "poison_family_id", "target_query_id", "intended_false_claim", "attacker_target_answer", "injection_payload", "corruption")

_TYPES = {"source_tier": "int", "content_word_count": "int", "reference_verified": "boolean", "tags": "array<string>", "cve_ids": "array<string>", "attack_techniques": "array<string>"}
#: Answer fields are in the reading schema, so a file that has one is seen whatever the others hold.
SCHEMA = ", ".join([*(f"{c} {_TYPES.get(c, 'string')}" for c in ALLOWED), *(f"{c} string" for c in FORBIDDEN)])


class AnswerLeak(ValueError):
    """A document carries a field that only an evaluation may see."""


def read_corpus(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Documents of folders with one JSON object a file, indexes left out, in the allowed columns.

    One aggregate checks all rows before they are handed on: answer fields, missing and repeated
    ids, and an empty corpus are errors.  ``embedding_text`` is added.
    """
    raw = spark.read.schema(SCHEMA).json(list(paths) if not isinstance(paths, str) else paths, multiLine=True, pathGlobFilter="*.json").where("_metadata.file_name <> 'index.json'")
    leaks = {c: F.max(F.col(c).isNotNull()).alias(c) for c in FORBIDDEN}
    per = raw.groupBy("doc_id").agg(F.count("*").alias("k"), *leaks.values())
    seen = per.agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max(F.coalesce("doc_id", F.lit("")) == "").alias("missing"), *[F.max(c).alias(c) for c in FORBIDDEN]).first()
    if not seen["n"]:
        raise FileNotFoundError(f"no documents under {paths}")
    if found := [c for c in FORBIDDEN if seen[c]]:
        raise AnswerLeak(f"documents carry {found}")
    if seen["missing"]:
        raise ValueError("a document has no doc_id")
    if seen["most"] > 1:
        raise ValueError("a doc_id occurs more than once")
    return raw.select(*ALLOWED).withColumn("embedding_text", embedding_text())


def embedding_text():
    """Title, summary and content, the empty ones left out, with a blank line between."""
    parts = F.filter(F.array("title", "summary", "content"), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.trim(F.array_join(parts, "\n\n"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, source_name, source_tier, ...) from a registry's map of sources."""
    entry = "struct<source_name: string, source_tier: int, source_type: string, publisher: string, base_url: string, attestation: string, license_note: string>"
    raw = spark.read.schema(f"sources map<string, {entry}>").json(path, multiLine=True)
    return raw.select(F.explode("sources").alias("source_id", "entry")).select("source_id", "entry.*")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ground_truth, poison_family_id, target_query_id, source_tier) from a manifest's map of labels."""
    entry = "struct<ground_truth: string, poison_family_id: string, target_query_id: string, source_tier: int>"
    raw = spark.read.schema(f"labels map<string, {entry}>").json(path, multiLine=True)
    return raw.select(F.explode("labels").alias("doc_id", "entry")).select("doc_id", "entry.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text): each line that is no comment, under the ``# q...`` name before it.

    A query file is small and its order matters, so it is read as one text and unfolded by place.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line")).select("place", F.trim("line").alias("line"))
    name = F.regexp_extract("line", r"^#\s*(q\S*)", 1)
    kept = lines.select("place", "line", F.when(name != "", name).alias("name"))
    named = kept.withColumn("query_id", F.last("name", ignorenulls=True).over(Window.orderBy("place")))  # one small file
    return named.where("line <> '' AND line NOT LIKE '#%'").select("query_id", F.col("line").alias("query_text"))


def with_controls(queries: DataFrame, docs: DataFrame, controls: int | None = None) -> DataFrame:
    """The queries and one for each document title; the first ``controls`` titles by id if given."""
    titles = docs.select("doc_id", F.col("title").alias("query_text")).where("query_text <> ''").orderBy("doc_id")
    titles = titles if controls is None else titles.limit(controls)
    return queries.select("query_id", "query_text", F.lit("target").alias("kind")).unionByName(titles.select(F.concat(F.lit("title:"), "doc_id").alias("query_id"), "query_text", F.lit("title").alias("kind")))


def append_log(records: DataFrame, path: str) -> None:
    """Add records to the log, one JSON line each; earlier files are never changed."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """Records of the log; malformed lines are skipped.  With ``limit``, the latest by ``logged_at``."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return rows if limit is None else rows.orderBy(F.desc("logged_at")).limit(limit)


def write_artefact(rows: DataFrame, path: str) -> None:
    """A fitted artefact (thresholds, coefficients) as one small table, replaced whole."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)
