"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from corvane.plans import agreements, audits, corpora, exams, formats, scores, selections, texts

    return [scores, agreements, selections, texts, audits, corpora, exams, formats]


def queries() -> dict[str, Query]:
    return {name: f for module in _modules() for name, f in module.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.query.sql.items()}
