"""Registered queries: name, the Spark function of (spark, sf_dir), and the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL that is too slow on large tables: the tests compare it on the smallest ones.
SLOW_SQL: dict[str, str] = {}


def query(sql: str | None = None, slow_sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        if slow_sql:
            SLOW_SQL[f.__name__] = slow_sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
