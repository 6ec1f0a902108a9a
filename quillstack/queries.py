"""All registered queries over the notes model, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name, with SQL for DuckDB where there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from quillstack.plans import query_jobs, query_pages  # noqa: E402, F401  they register themselves
