"""Registry of runnable queries, each with the DuckDB text it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gablestat.plans.binding import SQL_PAIR, SQL_VIEW

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under its operator id; ``sql`` is its check, None for rows only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def over_view(body: str, *ctes: str) -> str:
    """SQL over the assessment view ``a`` and further named subqueries."""
    return "WITH " + ",\n".join([SQL_VIEW, *ctes]) + "\n" + body


def over_pair(body: str, *ctes: str) -> str:
    """SQL over the view ``a`` and the property-by-snapshot panel ``p``."""
    return over_view(body, SQL_PAIR, *ctes)


def load_all() -> None:
    """Import every module that registers queries."""
    from gablestat.plans import (  # noqa: F401
        queries_columns,
        queries_comparison,
        queries_distributions,
        queries_groups,
        queries_inference,
        queries_models,
        queries_profile,
        queries_regression,
        queries_sources,
    )
