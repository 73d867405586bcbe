"""The registry: a query by its name, and the SQL that it agrees with on the same tables, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.files import table

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    from weftline.plans import composite_queries, fold_queries, graph_queries, relational_queries, report_queries, repository_queries, stream_queries, text_queries, tool_queries  # noqa: F401
