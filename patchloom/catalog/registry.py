"""Registered queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.catalog.oracle_base import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[tuple[str, str], ...] = ()):
    """Register a query; ``sql`` is the same result in DuckDB SQL."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, *views)
        return fn
    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return (queries, oracles)."""
    from patchloom.catalog import (  # noqa: F401
        context_queries,
        diff_queries,
        finding_queries,
        guidance_queries,
    )
    return QUERIES, ORACLES
