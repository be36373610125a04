"""Names, callables and SQL of the ledger queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Ledger, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers f(ledger) under a name; sql runs below the CTEs of the named views."""

    def add(f: Callable[[Ledger], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(views, sql) if views else sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["log_search_with_balance"](spark, sf_dir)
