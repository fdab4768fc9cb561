"""Query registry shared by the per-area plan modules.

``QUERIES[name]`` is a (spark, sf_dir) -> DataFrame callable; ``SQL[name]`` is the
equivalent DuckDB query over the driver tables (absent for rows-only checks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn=None, *, sql: str | None = None):
    def deco(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return deco(fn) if fn is not None else deco
