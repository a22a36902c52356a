"""Query registry: name -> (Spark builder, DuckDB oracle SQL).

Each query module registers its queries with :func:`query`; the Spark side
takes ``(spark, sf_dir)`` and returns a lazy DataFrame, the oracle side is a
DuckDB SQL string over the same parquet tables (or ``None`` when the query is
not expressible in SQL and is checked by row count plus unit tests).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "wardstats.plans.metrics_queries",
    "wardstats.plans.cost_queries",
    "wardstats.plans.profile_queries",
    "wardstats.plans.feature_queries",
    "wardstats.plans.prep_queries",
    "wardstats.plans.model_queries",
    "wardstats.plans.compare_queries",
    "wardstats.plans.insight_queries",
    "wardstats.plans.source_queries",
    "wardstats.plans.stream_queries",
)


def query(name: str, sql: str | None = None):
    """Register a Spark query builder under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
