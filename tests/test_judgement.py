"""Rules of judgement, ledger and report on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import judgement as J
from evidentia.operators import ledger as L
from evidentia.operators import report as P
from evidentia.operators import retrieval as R
from evidentia.operators import signals as S
from evidentia.operators import sweep

DOC = "rnk int, doc_id long, score double, source string, tier int, entailment double, unsupport double, anomaly double, injection double, conflict double"


def judged(spark, *docs):
    """docs: (tier, unsupport, anomaly, injection, conflict, score, source)."""
    rows = [(k, k, d[5], d[6], d[0], 1 - d[1], d[1], d[2], d[3], d[4]) for k, d in enumerate(docs, 1)]
    return J.classified(spark.createDataFrame([(1, rows)], f"query_id long, docs array<struct<{DOC.replace(' ', ': ').replace(',:', ',')}>>"))


def test_the_set_and_not_its_worst_document_decides(spark):
    r = judged(spark, (1, 0.9, 0.1, 0.0, 0.0, 1.0, "a"), (1, 0.1, 0.9, 0.0, 0.0, 1.0, "b")).first()
    assert (r.band, r.case_id) == ("MALICIOUS", "C5")


def test_isolated_outlier_needs_few_effective_documents(spark):
    lone = judged(spark, (2, 0.7, 0.9, 0.0, 0.0, 9.0, "a"), (2, 0.7, 0.1, 0.0, 0.0, 0.1, "a")).first()
    assert lone.n_eff <= 2 and lone.matched == ["C11", "C6"] and lone.case_id == "C11"
    spread = judged(spark, *[(2, 0.7, 0.9 * (k == 0), 0.0, 0.0, 1.0, str(k)) for k in range(4)]).first()
    assert spread.n_eff > 2 and spread.case_id == "C6"


def test_divergence_of_two_authorities(spark):
    r = judged(spark, (1, 0.02, 0.1, 0.0, 0.5, 1.0, "a"), (1, 0.9, 0.1, 0.0, 0.5, 1.0, "b")).first()
    assert r.tier1_conflict >= 0.85 and "C10" in r.matched and r.case_id == "C4"


def test_dominance_and_headline(spark):
    r = spark.range(1).select(
        J.dominant(F.lit("ACCEPT"), F.lit("REVIEW"), F.lit("NONE")).alias("a"), J.headline(F.lit("ODD"), F.lit(1)).alias("b"), J.headline(F.lit("ACCEPT"), F.lit(None).cast("int")).alias("c"), J.score_action(F.lit(None).cast("double"), F.lit(True)).alias("d"),
        J.score_action(F.lit(0.9), F.lit(False)).alias("e"),
    ).first()
    assert tuple(r) == ("REVIEW", "ORANGE", "ORANGE", "ACCEPT", "REVIEW")


def test_confidence_is_capped(spark):
    one = judged(spark, (1, 0.1, 0.0, 0.0, None, 1.0, "a")).withColumn("width", F.lit(0.0))
    r = J.confident(one).first()
    assert r.confidence == 0.3 and r.forced_review
    apart = judged(spark, (1, 0.0, 0.0, 0.0, 1.0, 1.0, "a"), (1, 1.0, 0.0, 0.0, 1.0, 1.0, "b")).withColumn("width", F.lit(0.0))
    assert J.confident(apart).first().confidence == 0.0


def test_robust_z(spark):
    rows = [(1, [5.0]), (2, [1.0, 1.0, 1.0, 9.0]), (3, [1.0, 2.0, 3.0, 4.0, 100.0])]
    z = {r.i: r.z for r in spark.createDataFrame(rows, "i long, v array<double>").select("i", S.robust_z(F.col("v")).alias("z")).collect()}
    assert z[1] == [0.0] and z[2] == [0.0] * 4 and z[3][4] == pytest.approx(97 / 1.4826) and z[3][2] == 0.0


def test_nearest_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, None)], "doc_id long, embedding array<float>")
    asked = rows.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(R.nearest(rows, asked, 4))
    monkeypatch.setattr(R, "BLOCK", 3)
    assert key(R.nearest(rows, asked, 4)) == whole and len(whole) == 80
    with pytest.raises(ValueError):
        R.nearest(rows, asked, 0)


def test_sweep_without_positives_or_rows(spark):
    none = spark.createDataFrame([(0, 0.2), (0, 0.9), (None, 0.5), (1, None)], "y int, s double")
    assert sweep.auc(sweep.swept(none)).first().auc == 0.0
    assert tuple(sweep.thresholds(sweep.swept(none)).first())[:3] == (1.0, 1.0, False)
    assert sweep.swept(none.where("false")).count() == 0


CONTENT = "chain string, seq long, decision_id long, event_id long, decision string, override_action string, reason_code string, reason_text string, decided_at string, supersedes long, decision_source string"


def test_ledger(spark):
    row = lambda chain, seq, decision="ACCEPT": (chain, seq, seq, 1, decision, None, None, None, "t", None, "analyst_ui")
    rows = spark.createDataFrame([row("a", 1), row("a", 2), row("b", 3)], CONTENT)
    first = L.append(None, rows)
    second = L.append(first, spark.createDataFrame([row("a", 4), row("c", 5)], CONTENT))
    whole = first.unionByName(second)
    told = {r.seq: r for r in L.verified(whole).collect()}
    assert not any(r.edited or r.unlinked for r in told.values())
    assert told[1].prev_row_hash == told[3].prev_row_hash == told[5].prev_row_hash == L.GENESIS and told[4].prev_row_hash == told[2].row_hash
    edited = whole.withColumn("decision", F.when(F.col("seq") == 2, "REJECT").otherwise(F.col("decision")))
    assert [r.seq for r in L.verified(edited).where("edited").collect()] == [2]
    assert [r.seq for r in L.verified(whole.where("seq <> 2")).where("unlinked").collect()] == [4]


def test_templates():
    assert P.numbers_in_templates() == []
    with pytest.raises(ValueError):
        P.filled("no_signal_fired")


def test_markdown_names_what_it_says(spark):
    from evidentia.plans import reports

    for r in reports.report_markdown(spark, "/root/testdata/sf0.001").collect():
        assert r.report_id in r.markdown and "## Reasoning" in r.markdown and "| 1 |" in r.markdown


def test_scratch_tables_go(spark):
    from evidentia.functions.storage import scratch, written

    with scratch(spark) as made:
        written(spark.range(3).toDF("a"), "gone")
        kept = written(spark.range(5).toDF("a"), "kept")
        stays = made.pop()
    assert kept.count() == 5 and len(made) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(made[0]).count()
    assert stays
