"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from banyan.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The test tables of a directory as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._folder, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables as a query; sql is the same result in DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        n = name or f.__name__
        QUERIES[n] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[n].__doc__ = f.__doc__
        if sql:
            SQL[n] = sql
        return f

    return add
