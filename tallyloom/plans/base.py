"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table


class Tables:
    """The tables of a data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Decorates a function of Tables as the query of a name."""

        def register(f: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return f

        return register
