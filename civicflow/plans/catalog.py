"""Registry of named queries (keys prefixed by SURVEY §2 ids) and their
independent DuckDB oracle SQL.

Every query reads the landed tables through the fixture views, so its work
grows with the data; no query runs on made-up input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_core, q_io, q_model, q_more, q_season, q_side, q_stream  # noqa: F401
