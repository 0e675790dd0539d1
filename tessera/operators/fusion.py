"""Fusing ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexical import ranked


def rrf(lists: list[DataFrame], key: str, k: int = 60, weights: list[float] | None = None, limit: int | None = None) -> DataFrame:
    """(qid, key, score, rank): reciprocal rank fusion of lists (qid, key, rank).

    The first place of a key in a list counts; later ones are passed over but
    keep their rank.  Ties by key.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("as many weights as lists are needed")
    parts = [
        ls.groupBy("qid", key).agg(F.min("rank").alias("rank")).select("qid", key, (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        for ls, w in zip(lists, weights)
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return ranked(whole.groupBy("qid", key).agg(F.round(F.sum("part"), 9).alias("score")), key, "score", limit)


def rerank_pool(heads: list[tuple[DataFrame, int]], fused: DataFrame, key: str, size: int = 20) -> DataFrame:
    """(qid, key, place): the first ``n`` of every channel in turn, then the fused order, once each, cut at ``size``."""
    whole = None
    for order, (ls, n) in enumerate([*heads, (fused, 1 << 30)]):
        part = ls.where(F.col("rank") <= n).select("qid", key, F.struct(F.lit(order).alias("o"), F.col("rank").cast("long").alias("r")).alias("at"))
        whole = part if whole is None else whole.unionByName(part)
    firsts = whole.groupBy("qid", key).agg(F.min("at").alias("at"))
    placed = firsts.select("qid", key, (-F.col("at.o") * F.lit(1 << 40) - F.col("at.r")).alias("order"))
    return ranked(placed, key, "order", size).select("qid", key, F.col("rank").alias("place"))


def source_of(in_symbol, in_bm25):
    """Which channel a hit is put down to: symbol before bm25 before vector."""
    return F.when(in_symbol, "symbol").when(in_bm25, "bm25").otherwise("vector")
