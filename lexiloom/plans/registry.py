"""Queries by name, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function (spark, folder) under its name, with the SQL that gives the same rows."""

        def register(function):
            self._queries[function.__name__] = function
            if sql:
                self._sql[function.__name__] = sql
            return function

        return register

    def queries(self) -> dict:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
