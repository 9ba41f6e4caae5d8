"""Plug-in points, indexes, answers and conformance on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import conformance as C
from evidentia.operators import models as M


def test_pairs_are_scored_once(spark):
    def load():
        def score(premises, claims):
            assert len(set(zip(premises, claims, strict=True))) == len(premises)
            return [len(p) / len(c) for p, c in zip(premises, claims, strict=True)]

        return score

    rows = [(1, "abcd", "ab"), (2, "abcd", "ab"), (3, None, "ab"), (4, " ", "ab"), (5, "a", "ab")]
    found = M.pair_scores(spark.createDataFrame(rows, "i long, premise string, claim string"), load)
    assert {r.i: r.score for r in found.collect()} == {1: 2.0, 2: 2.0, 3: None, 4: None, 5: 0.5}


def test_index_knows_its_model(spark, tmp_path):
    M.save_index(spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "doc_id long, embedding array<float>"), f"{tmp_path}/i", "hashed")
    assert M.load_index(spark, f"{tmp_path}/i", "hashed").count() == 2
    with pytest.raises(ValueError):
        M.load_index(spark, f"{tmp_path}/i", "other")
    spark.createDataFrame([(3, [0.0])], "doc_id long, embedding array<float>").write.mode("append").parquet(f"{tmp_path}/i/vectors")
    with pytest.raises(ValueError):
        M.load_index(spark, f"{tmp_path}/i", "hashed")


def test_answers_are_found_by_query_and_documents(spark):
    asked = spark.createDataFrame([("q", [1, 2]), ("q", [2, 1]), (None, [1])], "query string, doc_ids array<long>")
    key = asked.select(M.answer_key(F.col("query"), F.col("doc_ids")).alias("k")).first().k
    found = M.cached_answers(asked, spark.createDataFrame([(key, "b"), (key, "a")], "key string, answer string"))
    assert sorted(((r.doc_ids, r.answer) for r in found.collect()), key=str) == [([1, 2], "a"), ([1], None), ([2, 1], None)]


def test_small_ones(spark):
    r = spark.range(1).select(M.nan_to_null(F.lit(float("nan"))).alias("a"), M.nan_to_null(F.lit(2.0)).alias("b"), M.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("c")).first()
    assert tuple(r) == (None, 2.0, [0.5, 0.5])
    assert M.feature_ladder(["conflict", "anomaly"], 59) == {"rung": "base_only", "features": ["x_conflict", "is_tier1", "is_tier3"], "underpowered": True}
    assert M.feature_ladder([], 150)["rung"] == "full"


def test_placement(spark):
    one = lambda text, payload, how: spark.range(1).select(M.placed(F.lit(text), F.lit(payload), how).alias("t")).first().t
    body = "\n\n".join("abcdef")
    assert one(body, "P. Q.", "tail") == body + "\n\nP. Q.\n"
    assert one(body, "P. Q.", "mid") == "a\n\nb\n\nc\n\nP. Q.\n\nd\n\ne\n\nf\n"
    assert one(body, "P. Q.", "split") == "a\n\nb\n\nP.\n\nc\n\nd\n\nQ.\n\ne\n\nf\n"
    assert one("a\n\nb", "P. Q.", "split") == "a\n\nb\n\nP. Q.\n" and one(body, "P.", "split") == one(body, "P.", "mid")
    with pytest.raises(ValueError):
        M.placed(F.lit(""), F.lit(""), "top")


def test_conformance(spark):
    docs = spark.createDataFrame(
        [("a", "x/a.json", "2024-01-02", "2024-01-03", 1, True, None, "h1"), ("b", "x/c.json", "2024-02-30", None, 2, False, None, "h2"), ("c", "x/c.json", "2024-01-02", "2024-01-01", 3, True, "u", "h3")],
        "doc_id string, file string, ingestion_date string, published_date string, source_tier int, reference_verified boolean, reference_url string, content_sha256 string",
    )
    key = lambda df: sorted((r.scope, r.severity, r.message) for r in df.collect())
    assert key(C.file_names(docs)) == [("b", "error", "the file is named c")]
    assert key(C.dates(docs)) == [("a", "error", "published after ingestion"), ("b", "error", "ingestion_date is not a date"), ("b", "warning", "no published_date on a source of tier 1 or 2")]
    assert key(C.references(docs)) == [("a", "error", "verified without a reference_url")]
    index = spark.createDataFrame([("a", "h1"), ("c", "other"), ("d", "h4")], "doc_id string, content_sha256 string")
    assert key(C.index_agreement(docs, index, 4)) == [("b", "error", "not in the index"), ("c", "error", "the index has another hash"), ("d", "error", "in the index without a document"), ("index", "error", "the index declares 4 documents, there are 3")]
    assert key(C.symmetry(docs, docs.drop("file").withColumn("source_tier", F.lit("1")), "clean", "poisoned")) == [("file", "error", "only clean has it"), ("source_tier", "error", "int in clean, string in poisoned")]
    assert C.symmetry(docs, docs, "a", "b").count() == 0
