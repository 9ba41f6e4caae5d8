"""Both writings of the table queries on nulls, empty texts, repeated ids, and no rows at all."""

import duckdb
import pytest

from evidentia.plans import tables, tables_sql

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}
AT = "2024-01-01 01:02:03"
ROWS = {
    "documents": [
        (1, "One two  three\nfour", "en", "src0", 19), (2, None, "en", "src3", 0), (3, "", "fr", "src16", 0), (3, "", "fr", "src16", 5), (4, "x " * 500, None, "src17", 1000), (5, "  ", "xx", "src4", 2), (6, "a a a", "en", None, 5), (7, "Ä b1", "de", "src2", None),
    ],
    "labels": [(1, 1, 1), (2, 0, 1), (4, None, None), (9, 1, 2), (9, 1, 0), (3, 0, 0), (7, 1, 0)],
    "benchmark": [(1, "Alpha bravo alpha bravo x"), (2, None), (3, ""), (4, "?!"), (5, "one")],
    "embeddings": [(k, [float(k % 5) / 7, 0.25, -0.5 * (k % 3)], k % 2) for k in range(11)] + [(20, None, 1), (21, [0.5, 0.5, 0.5], None), (22, [3.0, -4.0, 9.0], 7)],
    "events": [(k, AT, k, ("view", "click", "signup", "purchase", "error")[k % 5], 1.0, '{"k": %d}' % k if k % 4 else None) for k in range(60)],
}


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 5) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(([cell(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module", params=["odd rows", "no rows"])
def place(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, schema in SCHEMAS.items():
        rows = ROWS[name] if request.param == "odd rows" else []
        text = schema.replace("ts timestamp", "ts string")
        df = spark.createDataFrame(rows, text)
        df = df.withColumn("ts", df.ts.cast("timestamp")) if name == "events" else df
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(tables.QUERIES))
def test_both_writings(spark, place, name):
    duck = duckdb.connect()
    for t in SCHEMAS:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{place}/{t}.parquet/*.parquet'")
    found, told = tables.QUERIES[name](spark, place), duck.sql(tables_sql.SQL[name])
    assert cells(found.columns, [tuple(r) for r in found.collect()]) == cells(told.columns, told.fetchall())
