"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    """Two tables by query name, and a decorator that enters a function (and the SQL it is given) under the function's name."""
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return keep

    return queries, oracle, query
