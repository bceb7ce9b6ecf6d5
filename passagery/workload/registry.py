"""The registered queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagery.session import ship_package
from passagery.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Table access by attribute: `t.documents`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load_table(self.spark, self.folder, name)


def query(sql: str | None = None, name: str | None = None):
    """Register `fn(tables) -> DataFrame` under its name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(Tables(ship_package(spark), folder))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
