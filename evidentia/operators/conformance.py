"""What a corpus has to conform to: rows (scope, severity, message) of what does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _findings(rows: DataFrame, scope: Column, rules: Sequence[tuple[str, Column, Column | str]]) -> DataFrame:
    """Rules (severity, when, message); a null condition finds nothing."""
    told = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))) for severity, when, message in rules]
    return rows.select(scope.cast("string").alias("scope"), F.explode(F.array_compact(F.array(*told))).alias("f")).select("scope", "f.severity", "f.message")


def file_names(docs: DataFrame) -> DataFrame:
    """Documents whose id is not the stem of their file; ``docs`` has doc_id and file."""
    stem = F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[^.]*$", "")
    return _findings(docs, F.col("doc_id"), [("error", F.col("doc_id").isNotNull() & (F.col("doc_id") != stem), F.concat(F.lit("the file is named "), stem))])


def is_date(text: Column) -> Column:
    """Whether a text is a day written as year-month-day."""
    return F.coalesce(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def dates(docs: DataFrame) -> DataFrame:
    """Days that are none, publication after ingestion, and none on sources of tier 1 and 2."""
    ingested, published = F.col("ingestion_date"), F.col("published_date")
    return _findings(docs, F.col("doc_id"), [
        ("error", ~is_date(ingested), "ingestion_date is not a date"),
        ("error", published.isNotNull() & ~is_date(published), "published_date is not a date"),
        ("error", is_date(published) & is_date(ingested) & (published > ingested), "published after ingestion"),
        ("warning", published.isNull() & F.col("source_tier").isin(1, 2), "no published_date on a source of tier 1 or 2"),
    ])


def references(docs: DataFrame) -> DataFrame:
    """References that were verified but lead nowhere."""
    return _findings(docs, F.col("doc_id"), [("error", F.col("reference_verified") & (F.coalesce(F.trim("reference_url"), F.lit("")) == ""), "verified without a reference_url")])


def symmetry(one: DataFrame, other: DataFrame, name: str, other_name: str) -> DataFrame:
    """Columns or kinds that only one of two partitions has: each is a label that tells them apart."""
    a, b = ({f.name: f.dataType.simpleString() for f in df.schema} for df in (one, other))
    rows = [(c, "error", f"only {name} has it") for c in a.keys() - b.keys()] + [(c, "error", f"only {other_name} has it") for c in b.keys() - a.keys()]
    rows += [(c, "error", f"{a[c]} in {name}, {b[c]} in {other_name}") for c in a.keys() & b.keys() if a[c] != b[c]]
    return one.sparkSession.createDataFrame(sorted(rows), "scope string, severity string, message string")


def index_agreement(docs: DataFrame, index: DataFrame, declared: int | None = None) -> DataFrame:
    """Documents and index entries (doc_id, content_sha256) that miss each other or differ, and a wrong count."""
    met = docs.select("doc_id", F.col("content_sha256").alias("own")).join(index.select(F.col("doc_id").alias("entry"), "content_sha256"), F.col("doc_id") == F.col("entry"), "full")
    found = _findings(met, F.coalesce("doc_id", "entry"), [
        ("error", F.col("entry").isNull(), "not in the index"), ("error", F.col("doc_id").isNull(), "in the index without a document"),
        ("error", F.col("doc_id").isNotNull() & F.col("entry").isNotNull() & ~F.col("own").eqNullSafe(F.col("content_sha256")), "the index has another hash"),
    ])
    if declared is None:
        return found
    count = docs.agg(F.count("*").alias("n"))
    return found.unionByName(_findings(count, F.lit("index"), [("error", F.col("n") != declared, F.concat(F.lit(f"the index declares {declared} documents, there are "), F.col("n").cast("string")))]))
