"""The engine's registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import fitted, judged, judged_sql, ledger, ledger_sql, measures, measures_sql, reports, reports_sql, tables, tables_sql, texts, texts_sql

#: Queries in the DataFrame API, with SQL of its own where SQL can say the same.
WRITTEN_TWICE = [(tables, tables_sql), (judged, judged_sql), (texts, texts_sql), (measures, measures_sql), (ledger, ledger_sql), (reports, reports_sql)]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(fitted.QUERIES)
    for module, _ in WRITTEN_TWICE:
        out |= module.QUERIES
    return out


def oracles() -> dict[str, str]:
    out = dict(fitted.ORACLES)
    for _, module in WRITTEN_TWICE:
        out |= module.SQL
    return out
