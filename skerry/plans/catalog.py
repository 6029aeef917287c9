"""The registry of the engine's own queries, each with a DuckDB twin.

``both`` registers a text that Spark and DuckDB share, ``pair`` two texts, ``dialect`` a text in the
accepted MySQL and PostgreSQL forms that the normaliser translates, and ``frame`` a function over
DataFrames. Every query reads whole tables; filters and projections reach the Parquet scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import table
from .normalize import to_spark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = re.compile(rf"\b({'|'.join(TABLES)})\b")


def over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query with the tables that it names as views."""
    for name in set(NAMES.findall(sql)):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def pair(name: str, spark_sql: str, duck_sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: over_tables(spark, sf_dir, spark_sql)
    ORACLE_SQL[name] = duck_sql


def both(name: str, sql: str) -> None:
    pair(name, sql, sql)


def dialect(name: str, sql: str, duck_sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: over_tables(spark, sf_dir, to_spark(sql))
    ORACLE_SQL[name] = duck_sql or sql


def frame(duck_sql: str | None):
    """Registers a function (spark, t) with t reading a table by name; no twin for None."""

    def add(f: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(spark, lambda t: table(spark, sf_dir, t))
        if duck_sql:
            ORACLE_SQL[name] = duck_sql
        return f

    return add


from . import queries_aggregate, queries_dml, queries_frames, queries_join, queries_scalar, queries_scan, queries_services, queries_subquery, queries_window  # noqa: E402, F401
