"""Named queries over the bound tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under the name of its operator."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return register
