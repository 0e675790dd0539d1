"""Filling a token budget with ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 4000


def pack(candidates: DataFrame, budget: int = BUDGET, budget_col: str | None = None) -> DataFrame:
    """(qid, chunk_id, score, tokens, place): what fits, by falling score.

    Candidates (qid, chunk_id, blob_hash, byte_start, byte_end, breadcrumb,
    score, tokens) are visited by score per token; one that is over the rest of
    the budget, has the breadcrumb of a kept one, or overlaps a kept one of its
    blob is passed over, and later ones are still tried.  Empty breadcrumbs never
    clash.  The fold runs over one query's candidates, which channels bound.
    """
    if budget < 0:
        raise ValueError("the budget must not be negative")
    cost = F.greatest(F.lit(1), F.col("tokens")).cast("int")
    item = F.struct(
        (-(F.col("score") / cost)).alias("density"),
        (-F.col("score")).alias("neg"),
        "chunk_id",
        cost.alias("cost"),
        F.coalesce("breadcrumb", F.lit("")).alias("crumb"),
        "blob_hash",
        F.col("byte_start").cast("int").alias("a"),
        F.col("byte_end").cast("int").alias("b"),
        F.col("tokens").cast("int").alias("tokens"),
    )
    limit = F.col(budget_col).cast("int") if budget_col else F.lit(budget)
    keys = ["qid"] + ([budget_col] if budget_col else [])
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = lists.schema["items"].dataType
    empty = F.array().cast(kind)

    def visit(acc, x):
        clash = F.exists(
            acc["kept"],
            lambda y: ((x["crumb"] != "") & (y["crumb"] == x["crumb"]))
            | ((y["blob_hash"] == x["blob_hash"]) & (y["a"] < x["b"]) & (x["a"] < y["b"])),
        )
        fits = acc["total"] + x["cost"] <= acc["budget"]
        return F.when(
            fits & ~clash,
            F.struct((acc["total"] + x["cost"]).alias("total"), F.concat(acc["kept"], F.array(x)).alias("kept"), acc["budget"].alias("budget")),
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("total"), empty.alias("kept"), limit.alias("budget"))
    kept = lists.select("qid", F.aggregate("items", start, visit)["kept"].alias("kept"))
    ordered = F.array_sort(F.transform("kept", lambda y: F.struct(y["neg"].alias("neg"), y["chunk_id"].alias("chunk_id"), y["tokens"].alias("tokens"))))
    return kept.select("qid", F.posexplode(ordered).alias("place", "r")).select(
        "qid", F.col("r.chunk_id").alias("chunk_id"), (-F.col("r.neg")).alias("score"), F.col("r.tokens").alias("tokens"), (F.col("place") + 1).alias("place")
    )
