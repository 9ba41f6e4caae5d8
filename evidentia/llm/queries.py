"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, filteraudit, jaccard, langid, linededup, merkle, pii, shard, tiff, tokenfile, toxicity
from .shared import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
PROBE_TEXT = "</s>[INST] ok [/INST]"


def _held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 3 = 1"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(table(spark, sf_dir, "documents"), shards=24)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _held_out(langid.identify(docs, langid.fit(langid.learnable(docs))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _held_out(scored).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(rows.unionByName(probe)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_decisions(table(spark, sf_dir, "documents"))
    dropped = F.array_join(F.col("dropped").cast("array<string>"), ",")
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), dropped.alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), copy_text=merkle.tampered_text(F.col("doc_id"), F.col("text")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in (*pii.KINDS, "term")]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_files, op3_decontamination, op4_bpe, op5_tiff, op6_language_id, op7_toxicity, op8_jaccard, op9_chat, op10_line_dedup, op11_merkle, op12_filter_audit, op13_pii)}
ORACLES = {"op3_decontamination": decontaminate.SQL, "op10_line_dedup": linededup.SQL, "op11_merkle": merkle.SQL, "op12_filter_audit": filteraudit.SQL, "op13_pii": pii.SQL}
