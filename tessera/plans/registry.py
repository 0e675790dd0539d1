"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import change_queries, index_queries, search_queries

_MODULES = [change_queries, index_queries, search_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return change_queries.p3_found(spark, folder)
