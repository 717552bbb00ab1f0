"""Registry of runnable queries: a Spark plan and, where SQL can say it, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumeflux.fixtures import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(inputs)`` under ``name`` with the equivalent SQL over ``views``."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql, *views.split())
        return fn

    return wrap
