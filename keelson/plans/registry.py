"""Registered checks: every operator of the inventory as a query over the driver's tables, with
the equivalent DuckDB SQL where one exists. ``__spark_entry__`` exposes these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return deco


def _load_all() -> None:
    # importing the catalog modules registers their queries
    from keelson.plans import catalog_features, catalog_metrics, catalog_order, catalog_project  # noqa: F401
    from keelson.plans import catalog_sources, catalog_tuning  # noqa: F401


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
