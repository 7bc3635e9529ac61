"""Registration of a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; without SQL only its rows are checked."""

    def register(build: Query) -> Query:
        key = name or build.__name__
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
