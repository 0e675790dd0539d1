"""Small text inputs: gold sets as JSON lines, query files, ignore files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "id string, type string, query string, expected_files array<string>, expected_symbols array<string>"
LEAST_GOLD = 20


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """The gold queries of a JSON-lines file; fewer than 20 are refused."""
    gold = spark.read.schema(GOLD).json(path).where("id is not null")
    n = gold.count()
    if n < LEAST_GOLD:
        raise ValueError(f"{path} has {n} gold queries; {LEAST_GOLD} are needed")
    return gold


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(query): the lines of a text file that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")
