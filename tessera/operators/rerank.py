"""Second-stage ranking: passages in focus, a pluggable scorer, blending, and cutting replies to size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import package_of
from tessera.functions.text import query_terms
from tessera.operators.fusion import rrf

MOST_CHARS, SMALL_INDEX, BLEND_SMALL, BLEND_LARGE = 700, 512, 4.0, 1.0


def focus(terms: list[str], label: str, code: str, line_terms: list[list[str]], most_chars: int = MOST_CHARS) -> str:
    """The label and the window of whole lines that holds most of the terms, the earliest on ties.

    Code that fits comes whole; a line that alone doesn't is cut.  A window is
    told by its first line, as it reaches as far as there is room; a term is in
    it if the next line that holds the term is.
    """
    room = max(0, most_chars - len(label) - 1)
    if len(code) <= room or not room:
        return f"{label}\n{code[:room]}"
    breaks = np.flatnonzero(np.frombuffer(code.encode("utf-32-le"), np.uint32) == 10) + 1
    starts = np.concatenate(([0], breaks[breaks < len(code)], [len(code)]))
    first = np.arange(len(starts) - 1)
    upto = np.searchsorted(starts, starts[:-1] + room, "right") - 1
    reach = np.maximum(upto, first + 1)
    held = np.zeros(len(first), np.int64)
    places: dict[str, list[int]] = {}
    for n, found in enumerate(line_terms[: len(first)]):
        for t in found:
            places.setdefault(t, []).append(n)
    for t in set(terms) & places.keys():
        at = np.array([*places[t], len(first) + 1])
        held += at[np.searchsorted(at, first)] < reach
    best = int(held.argmax())
    return f"{label}\n{code[starts[best] : starts[upto[best]]] or code[starts[best] : min(starts[best + 1], starts[best] + room)]}"


def passages(pool: DataFrame, queries: DataFrame, chunks: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(qid, chunk_id, place, query, passage) of a rerank pool (qid, chunk_id, place).

    Terms of queries and lines come from one expression; lines end at LF.
    """
    asked = queries.select("qid", "query", F.coalesce(query_terms(F.col("query")), F.array().cast("array<string>")).alias("terms"))
    code = F.coalesce("code", F.lit(""))
    rows = pool.join(asked, "qid").join(chunks.select("chunk_id", F.coalesce("breadcrumb", F.lit("")).alias("label"), code.alias("code")), "chunk_id")

    @F.pandas_udf("string")
    def cut(terms, label, code, line_terms):
        import pandas as pd

        return pd.Series([focus(list(t), b, c, [list(x) for x in n], most_chars) for t, b, c, n in zip(terms, label, code, line_terms)])

    line_terms = F.transform(F.split("code", "\n"), query_terms)
    return rows.select("qid", "chunk_id", "place", "query", cut("terms", "label", "code", line_terms).alias("passage"))


def rerank(rows: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """(qid, chunk_id, score, rank): ``score`` maps pairs (query, passage) to raw scores, which a sigmoid bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column("query").to_pylist(), batch.column("passage").to_pylist()))
            raw = score(pairs) if pairs else []
            if len(raw) != len(pairs):
                raise ValueError("the scorer gave another number of scores than pairs")
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid"), batch.column("chunk_id"), batch.column("place"), pa.array([float(x) for x in raw], pa.float64())],
                names=["qid", "chunk_id", "place", "raw"],
            )

    kinds = dict(rows.dtypes)
    scored = rows.select("qid", "chunk_id", "place", "query", "passage").mapInArrow(
        run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, place {kinds['place']}, raw double"
    )
    bounded = F.when(F.col("raw") >= 0, 1 / (1 + F.exp(-F.col("raw")))).otherwise(F.exp("raw") / (1 + F.exp("raw")))
    order = Window.partitionBy("qid").orderBy(F.desc("raw"), "place")
    return scored.select("qid", "chunk_id", F.round(bounded, 9).alias("score"), F.row_number().over(order).alias("rank"))


def blend(reranked: DataFrame, vector_list: DataFrame, blobs: DataFrame) -> DataFrame:
    """(qid, chunk_id, score, rank): the reranked order fused with the whole vector order, kept to the pool.

    Vectors weigh four times on small indexes and as much on large ones; the size
    is the number of active blobs (blob_hash, active).
    """
    active = blobs.where("active").select("blob_hash").distinct().limit(SMALL_INDEX + 1).count()
    weight = BLEND_SMALL if active <= SMALL_INDEX else BLEND_LARGE
    fused = rrf([reranked.select("qid", "chunk_id", "rank"), vector_list.select("qid", "chunk_id", "rank")], "chunk_id", weights=[1.0, weight])
    return fused.join(reranked.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_semi")


def trim_replies(packed: DataFrame, budget: int) -> DataFrame:
    """(qid, place, ..., truncated): packed rows (qid, place, row_chars) as long as the reply so far fits.

    A reply costs a quarter of its characters; rows are dropped from the end, and
    ``truncated`` says how many went.
    """
    order = Window.partitionBy("qid").orderBy("place")
    used = packed.withColumn("_used", F.floor((F.sum("row_chars").over(order) + 3) / 4))
    whole = Window.partitionBy("qid")
    kept = used.withColumn("_kept", (F.col("_used") <= budget).cast("int"))
    return (
        kept.withColumn("truncated", (F.count("*").over(whole) - F.sum("_kept").over(whole)).cast("int"))
        .where("_kept = 1").drop("_used", "_kept")
    )


def date_fraction(when) -> "F.Column":
    """Days since 2000 by a century, below one; zero if unknown."""
    days = F.greatest(F.lit(0.0), F.unix_micros(when.cast("timestamp")) / 86_400e6 - 10_957)
    return F.coalesce(F.least(days / 36_500, F.lit(0.999)), F.lit(0.0))


def rank_related(pairs: DataFrame, inbound: DataFrame, changed: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, node, score, rank): related nodes by proximity, then incoming edges, then recency.

    ``pairs`` are (qid, node, path, byte_start, target_path, at), ``at`` being the
    order in which relations were found: of several of one node the first counts.
    ``inbound`` is (node, n), ``changed`` (path, at_date).
    """
    first = Window.partitionBy("qid", "node").orderBy("at")
    once = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    near = F.when(F.col("path") == F.col("target_path"), 2).when(package_of(F.col("path")) == package_of(F.col("target_path")), 1).otherwise(0)
    scored = once.join(inbound, "node", "left").join(changed, "path", "left").withColumn(
        "score", F.round(near * 1000 + F.least(F.coalesce("n", F.lit(0)), F.lit(99)) * 10 + date_fraction(F.col("at_date")), 6)
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "path", "byte_start", "node")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "node", "score", "rank")


def last_changes(log: DataFrame) -> DataFrame:
    """(path, at_date): when the newest commit (by place in the log) touched each path; ``log`` is (ordinal, at_date, path)."""
    return log.where("path is not null").groupBy("path").agg(F.max_by("at_date", "ordinal").alias("at_date"))
