"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle per ID."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Import every query module (they register on import) and return both registries."""
    from . import q_catalog, q_diagnostics, q_fleet, q_logs, q_streams, q_topics  # noqa: F401
    from .oracle import ORACLE

    return dict(QUERIES), dict(ORACLE)
