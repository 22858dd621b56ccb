"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import PRELUDE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Registers a function of the views under ``name``."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            if prelude and sql.lstrip().startswith(", "):
                ORACLE_SQL[name] = PRELUDE + sql
            else:
                ORACLE_SQL[name] = (PRELUDE if prelude else "") + sql
        return f

    return add


from . import audit_queries, effect_queries, grid_queries, matrix_queries, read_queries, registration_queries, report_queries, sequence_queries, source_queries, table_queries  # noqa: E402, F401
