"""Retrieval quality: recall, reciprocal rank, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(ranked: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(qid, type, rank): rank of the first expected result of each gold query, null without any."""
    hits = ranked.join(gold.select("qid", key).distinct(), ["qid", key], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid", "type").distinct().join(hits, "qid", "left")


def quality(ranked: DataFrame, gold: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(type, n, recall, mrr, mrr_at_k) by query type."""
    hit = F.col("rank") <= k
    back = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return first_hits(ranked, gold, key).groupBy("type").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("recall"),
        F.round(F.avg(back), 6).alias("mrr"),
        F.round(F.avg(F.when(hit, back).otherwise(0.0)), 6).alias("mrr_at_k"),
    )


def passes_gate(recall: float, mrr: float, singles: list[float], least_recall: float = 0.8, least_mrr: float = 0.6) -> bool:
    """Thresholds reached and every single channel beaten."""
    return recall >= least_recall and mrr >= least_mrr and all(recall > s for s in singles)
