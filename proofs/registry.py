"""Registry of queries: a Spark callable and, if SQL can say it, the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardline.session import ship_code
from proofs.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def proof(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use the shared views by name."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(ship_code(spark), sf_dir))
        if sql:
            ORACLES[name] = SQL_VIEWS + sql.strip()
        return fn

    return add
