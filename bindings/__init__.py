"""Every operator bound to the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolex.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where plain SQL can say it, its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


def load_all() -> None:
    from bindings import budgets, catalogs, changes, directory, documents, pages, places, stored  # noqa: F401
