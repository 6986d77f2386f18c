"""The registered queries of the library's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueflow.plans.fixtures import Tables, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles to six places, so that rows of two engines compare."""
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)
        return c.cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else c.alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def register(name: str, build: Callable[[Tables], DataFrame], uses: str = "", sql: str | None = None) -> None:
    """build gets the tables; sql (over the tables in uses) gives the same rows, or is left out."""
    QUERIES[name] = lambda spark, sf_dir: plain(build(Tables(spark, sf_dir)))
    if sql:
        ORACLE[name] = f"{duckdb_with(*uses.split())} {sql}" if uses else sql

