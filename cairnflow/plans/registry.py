"""Named queries and the SQL that each is compared with.

``@query(sql, view, ...)`` registers a function of (spark, view ...) DataFrames; the SQL sees the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnflow.sources.views import VIEWS, as_cte, view

#: The moment that queries take as now.
NOW = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, *(view(spark, sf_dir, v) for v in views))

        QUERIES[f.__name__] = run
        if sql is not None:
            ctes = [v for v in views if v in VIEWS]
            SQL[f.__name__] = sql if not ctes else f"{as_cte(*ctes)}{', ' + sql[5:] if sql.upper().startswith('WITH ') else ' ' + sql}"
        return f

    return register
