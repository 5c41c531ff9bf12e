"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import EVENTS_SQL, ITEMS_SQL, USERS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH = f"WITH {EVENTS_SQL}, {USERS_SQL}, {ITEMS_SQL}"


def query(sql: str | None = None):
    """Register a function by its name; ``sql`` follows the views ev, us and it, either a SELECT or ``, view AS (...) SELECT``."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{WITH}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}"
        return f

    return put
