"""All registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, tables: str, make: Callable[..., DataFrame], sql: str | None) -> None:
    """Register make(*tables) and its SQL, which may use all views."""
    QUERIES[name] = lambda spark, sf_dir: make(*[view(spark, sf_dir, t) for t in tables.split()])
    if sql:
        ORACLES[name] = with_views(sql)
