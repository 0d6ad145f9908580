"""Registry of queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r(expr: str, places: int) -> str:
    """SQL twin of ``half_up``."""
    scale = f"{10 ** places}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"
