"""Names of queries, each with its function and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return put


REGISTRY = Registry()


def load_all() -> Registry:
    """Imports every module that registers queries."""
    from quillon import queries  # noqa: F401

    return REGISTRY
