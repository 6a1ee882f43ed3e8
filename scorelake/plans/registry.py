"""Registry of named queries over the shared tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_(ctes: str, select: str) -> str:
    return f"with recursive {ctes}\n{select}"


def rounded(expr: str, digits: int) -> str:
    """DuckDB text for rounding on the binary value, as ``py_round`` does."""
    return f"cast(printf('%.{digits}f', cast({expr} as double)) as double)"
