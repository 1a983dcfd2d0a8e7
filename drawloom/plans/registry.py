"""A registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL for some."""

    def __init__(self) -> None:
        self.functions: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def added(query: Query) -> Query:
            self.functions[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return added
