"""How queries are registered: a function of (spark, sf_dir) with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of a module, by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"there is a query {f.__name__} already")
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


def joined(registries: list[Registry]) -> tuple[dict[str, Query], dict[str, str]]:
    """The queries and the SQL of several modules; no two of them may share a name."""
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}
    for r in registries:
        if both := queries.keys() & r.queries.keys():
            raise ValueError(f"two modules have the queries {sorted(both)}")
        queries |= r.queries
        oracle |= r.oracle
    return queries, oracle
