"""Every plan gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from evidentia.plans import fitted
from evidentia.plans.queries import TABLES, WRITTEN_TWICE

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(float(v), 5) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(([cell(r[i]) for i in order] for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(n for _, module in WRITTEN_TWICE for n in module.SQL))
def test_written_twice(spark, duck, name):
    module, sql = next(pair for pair in WRITTEN_TWICE if name in pair[1].SQL)
    found, told = module.QUERIES[name](spark, SF), duck.sql(sql.SQL[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(fitted.ORACLES))
def test_fitted_against_sql(spark, duck, name):
    found, told = fitted.QUERIES[name](spark, SF), duck.sql(fitted.ORACLES[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(fitted.QUERIES) - set(fitted.ORACLES)))
def test_fitted(spark, name):
    assert fitted.QUERIES[name](spark, SF).count() >= (0 if name == "entity_ipv6" else 4)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
