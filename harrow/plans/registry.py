"""All queries of the reference's operator families, on the driver's tables, with their SQL.

Names begin with the families of the blueprint (a sources, b projections, c filters, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import changes, classification, cohorts, inference, landing, lookups, names, portfolio, projections, reading, reports, requests, resolution, results, rules, statistics, studies  # noqa: E402, F401
