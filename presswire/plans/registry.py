"""Where query modules put their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswire.plans.fixtures import duck

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with DuckDB SQL over ``views``."""

        def put(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = duck(sql, *views) if views else sql
            return query

        return put
