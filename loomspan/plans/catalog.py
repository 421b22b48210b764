"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (query, SQL or None)
CATALOG: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None):
    """Add a query to the catalog under its function's name."""

    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add
