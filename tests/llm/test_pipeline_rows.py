"""The pipeline's row decisions against brute force, on null, repeated and shared ids."""

import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string"
A, B, C = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
PASSAGE = " ".join(f"p{i}" for i in range(20))
ROWS = [
    (1, A), (1, A), (2, A + " more"), (None, A), (None, A + " other"), (3, B), (3, A + " end"), (None, C), (None, C), (None, "only one such text is here at all"),
    (4, "x " + PASSAGE), (4, "a clean text under the same id"), (None, PASSAGE + " y"), (None, "a clean text without an id"), (5, B + " " + PASSAGE), (9, C + " late"),
]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def table(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], SCHEMA)


def found(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for a, (_, s) in enumerate(ROWS):
            for b, (_, t) in enumerate(ROWS):
                x, y = shingles(s), shingles(t)
                if 4 * len(x & y) >= 3 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    sizes = [[ROWS[k] for k in range(len(ROWS)) if group[k] == g] for g in sorted(set(group))]
    kept = corpus_pipeline.near_duplicates(spark, table(spark), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    out = found(kept)
    assert len(out) == len(sizes) < len(ROWS)
    for rows in sizes:
        ids = [i for i, _ in rows if i is not None]
        want = min(ids) if ids else None
        assert sum(row in out and row[0] == want for row in set(rows)) == 1


def test_contaminated_rows_go_by_row(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def contaminated(text):
        w, p = re.findall(r"[a-z0-9]+", text), PASSAGE.split()
        windows = {tuple(p[i : i + 13]) for i in range(len(p) - 12)}
        hit = {k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for k in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert sum(contaminated(t) for _, t in ROWS) == 3
    want = sorted(((i, t) for i, t in ROWS if not contaminated(t)), key=str)
    assert found(corpus_pipeline.decontamination(spark, table(spark), str(tmp_path))) == want


CLASHING = ["row_key", "key", "row", "kept", "stay", "lines", "named", "class", "n", "n_words", "spans", "new"]


def test_other_columns_stay_as_they_are(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en", *[f"{k} of {c}" for c in CLASHING]) for k, (i, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHING))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and set(map(tuple, out.collect())) < set(rows)
    lines = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and {r[3:] for r in map(tuple, lines.collect())} <= {r[3:] for r in rows}


def test_the_same_one_of_repeated_rows_stays(spark):
    rows = [(1, A, lang) for lang in ("de", "en", "fr", None)]
    kept = [tuple(corpus_pipeline.near_duplicates(spark, spark.createDataFrame(some, SCHEMA).repartition(3), "").collect()[0]) for some in (rows, rows[::-1])]
    assert kept[0] == kept[1] and kept[0] in rows


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty(), name
