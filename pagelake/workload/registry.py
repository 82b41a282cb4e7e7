"""Registry of the queries over the given tables, each with its SQL twin where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.session import shared_dir, ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name: ``t.pages``, ``t.events``, …"""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = ship(spark), folder

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}.parquet"

    def scratch(self, name: str) -> str:
        """A fresh folder for what a query writes, where all executors can reach it."""
        return f"{shared_dir(self._spark)}/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
