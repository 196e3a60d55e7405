"""Registration of the runnable queries and of the DuckDB text each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources.adapters import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``; ``sql`` is the equivalent DuckDB query."""
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(fixtures(spark, folder))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


_FIXTURES: dict[tuple, Fixtures] = {}


def fixtures(spark: SparkSession, folder: str) -> Fixtures:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixtures(spark, folder)
    _FIXTURES[key].t.__init__(spark, folder)  # session options may have been changed by the caller
    return _FIXTURES[key]
