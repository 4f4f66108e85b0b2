"""Where the modules of queries leave their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    """Registers a query ``(spark, folder) -> DataFrame`` under its own name; ``sql`` says the same, empty where SQL can't."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scriptorium.plans import MODULES  # noqa: F401  each module registers its queries when it is imported

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from scriptorium.plans import MODULES  # noqa: F401

    return dict(SQL)
