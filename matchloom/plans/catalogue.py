"""The registered profile-matching queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.operators import matching
from matchloom.plans import fixtures
from matchloom.settings import SMALL_TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL if SQL can express it."""

    def take(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return take


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best profiles of each user of the smallest tables."""
    return matching.reverse(fixtures.users(fixtures.unit_items(spark, sf_dir)), fixtures.profiles(spark, sf_dir, SMALL_TABLES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from matchloom.plans import matching_queries, parsing_queries, serving_queries, text_queries, work_queries  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
