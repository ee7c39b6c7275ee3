"""Registered queries over the given tables and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL where there is any."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


from . import cohort_queries, metric_queries, statistics_queries  # noqa: E402, F401
