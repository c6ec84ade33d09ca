"""Named queries, each with the SQL another engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def named(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(build: Query) -> Query:
            self.queries[name] = build
            if oracle is not None:
                self.oracles[name] = oracle
            return build

        return register
