"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.storage import remove, scratch
from evidentia.llm.bpe import round_trip
from evidentia.llm.decontaminate import decontaminate
from evidentia.llm.jaccard import jaccard_classes
from evidentia.llm.langid import keep_identified
from evidentia.llm.linededup import dedup_lines
from evidentia.llm.shared import document_key, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null, has no letter or is far from every learned language go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and documents that lose all their lines.

    A null text has no lines and stays; an empty text is one empty line, which is too short to go.  Rows with
    the same doc_id and text keep the same lines.  Of no documents none are left.
    """
    return dedup_lines(docs)


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no name clashes, beside 128 bits that stand for its id and text, a null id being an id like any other."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), document_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document with the smallest id stays; a null id comes last.

    Documents without a word link with nothing.  Rows with the same doc_id and text are one document, of
    which one row stays: the one whose JSON has the smallest digest, so that any run keeps the same.
    """
    groups = stored(jaccard_classes(docs, document_key(F.col("doc_id"), F.col("text").cast("string"))).select("doc_id", "key", "class"), "groups")
    keys = groups.groupBy("key").agg(F.first("class").alias("class"), F.count("*").alias("n"))
    first = groups.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))["key"].alias("key"))
    dropped = keys.where("class is not null").join(first.select("key"), "key", "left_anti").select("key")
    repeated = keys.where("n > 1").select("key")
    rest = _rows(docs).join(dropped, "key", "left_anti")
    one = rest.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return _unpacked(rest.join(repeated, "key", "left_anti").select("row").unionByName(one.select("row")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a share that matters go.

    Null and empty texts are clean.  Rows with the same doc_id and text stay or go together.
    """
    rows = _rows(docs)
    found = decontaminate(rows.select(F.hex("key").alias("doc_id"), F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"))
    found = found.where("contaminated").select(F.unhex("doc_id").alias("key")).distinct()
    return _unpacked(rows.join(found, "key", "left_anti"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them; one row for each row, a null text as an empty one."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language id", language_id), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("bpe", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written in the shared folder and read again.

    What a stage wrote on its way, and the documents that it read, go once its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            own = made.pop()
        if before:
            remove(spark, before)
        before = own
    return docs


#: No SQL: language ID and BPE are not expressible.  tests/llm hold near duplicates and decontamination
#: against brute force on rows with null, shared and repeated ids, and the encoding against the library.
ORACLE_SQL = None
