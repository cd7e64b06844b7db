"""Registry of the named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelproof.bindings.views import VIEWS, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# Steps shared by several check queries, in the dialect of the checking engine.
CHECK_VIEWS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the SQL that gives the same rows another way."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def check_sql() -> dict[str, str]:
    """Check SQL of every query that has one, with its views spelled out."""
    known = {**VIEWS, **CHECK_VIEWS}
    return {name: with_views(sql, known, "check") for name, sql in CHECKS.items()}
