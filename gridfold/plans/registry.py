"""Registry of queries: each is (spark, folder) -> DataFrame, with a SQL twin where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _widened(fn: Query) -> Query:
    """Results carry BIGINT for every integer column, as the SQL twins do."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = fn(spark, folder)
        return out.select([out[f"`{c}`"].cast("long").alias(c) if t in ("int", "smallint", "tinyint") else out[f"`{c}`"] for c, t in out.dtypes])
    run.__doc__ = fn.__doc__
    return run


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB statement that must give the same rows."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = _widened(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
