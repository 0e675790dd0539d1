"""One search: names of definitions, words and vectors together, for a batch of queries.

Queries that name a definition are answered by the symbol router, together with
discounted neighbours.  The others go through three channels - BM25, vectors,
fuzzy symbols - which are fused by reciprocal ranks; a pool of their heads may be
reranked; neighbours of the best come in at a discount; what fits the budget is
packed.  Inactive content is left out everywhere, while the statistics of BM25
are those of the whole collection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import retrieval_tokens
from tessera.operators import fusion, graph, lexical, packing, rerank, store, symbols, vectors
from tessera.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    channel_k: int = 100
    heads: int = 8
    pool: int = 20
    budget: int = packing.BUDGET
    expand: bool = True
    channels: tuple[str, ...] = ("bm25", "vector", "symbol")
    use_router: bool = True
    score: Callable | None = None
    weights: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Index:
    """The tables of an index: chunks, blobs (blob_hash, active), symbols (symbol, kind, path, chunk_id, byte_start) and
    call edges (src, dst, kind) between chunks; vectors (chunk_id, vector) may be missing."""

    chunks: DataFrame
    blobs: DataFrame
    symbols: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None


def routed(index: Index, queries: DataFrame, discount: float = 0.6) -> DataFrame:
    """(qid, chunk_id, score): definitions that the query names, and their neighbours at a discount."""
    found = symbols.route(index.symbols, queries).select("qid", "chunk_id", "score")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    near = graph.expand(found.withColumn("rank", F.row_number().over(order)), index.edges, discount=discount)
    return found.unionByName(near.select("qid", "chunk_id", "score"))


def fuzzy(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, rank): chunks with symbols that hold a term of the query; an earlier term, then a better hit first."""
    terms = symbols.fuzzy_terms(queries)
    order = Window.partitionBy("qid").orderBy("term")
    asked = terms.withColumn("at", F.row_number().over(order)).select(F.struct("qid", "at").alias("qid"), F.col("term").alias("name"))
    hits = symbols.symbol_search(index.symbols, asked).select("qid.qid", F.struct("qid.at", "rank").alias("place"), "chunk_id")
    first = hits.groupBy("qid", "chunk_id").agg(F.min("place").alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place", "chunk_id")))
    return ranked.where(F.col("rank") <= k).select("qid", "chunk_id", "rank")


def search(index: Index, queries: DataFrame, settings: Settings = Settings(), query_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, tokens, place, source): packed results of every query (qid, query).

    ``query_vectors`` (qid, vector) feeds the vector channel; without it, or
    without vectors in the index, that channel is empty.  ``source`` is router,
    or the channel a hit is put down to: symbol before bm25 before vector, else
    graph for neighbours.  ``settings.channels`` with one entry gives a retriever
    of that channel alone.  A query without a hit has no row.
    """
    live = store.active_only(index.chunks, index.blobs).dropDuplicates(["chunk_id"])
    alive = Index(live, index.blobs, index.symbols.join(live.select("chunk_id"), "chunk_id", "left_semi"), index.edges, index.vectors)
    lists: dict[str, DataFrame] = {}
    if "bm25" in settings.channels:
        whole = index.chunks.dropDuplicates(["chunk_id"])
        lists["bm25"] = lexical.bm25(whole, queries, "chunk_id", "breadcrumb", "code", k=settings.channel_k, active=live, active_on="chunk_id").select("qid", "chunk_id", "rank")
    if "vector" in settings.channels and query_vectors is not None and index.vectors is not None:
        held = index.vectors.join(live.select("chunk_id"), "chunk_id", "left_semi")
        lists["vector"] = vectors.top_k(held, query_vectors, "chunk_id", "vector", k=settings.channel_k).select("qid", "chunk_id", "rank")
    if "symbol" in settings.channels:
        lists["symbol"] = fuzzy(alive, queries, settings.channel_k)
    lists = {n: cut_lineage(ls) for n, ls in lists.items()}  # small, and read several times
    names = list(lists)
    fused = fusion.rrf([lists[n] for n in names], "chunk_id", weights=[settings.weights.get(n, 1.0) for n in names])
    if settings.score is not None:
        pool = fusion.rerank_pool([(lists[n], settings.heads) for n in names], fused, "chunk_id", settings.pool)
        done = rerank.rerank(rerank.passages(pool, queries, live), settings.score)
        best = rerank.blend(done, lists["vector"], index.blobs) if "vector" in lists else done
    else:
        best = fused.where(F.col("rank") <= settings.pool)
    best = cut_lineage(best.select("qid", "chunk_id", "score", "rank"))
    where = None
    for n in names:
        part = lists[n].select("qid", "chunk_id", F.lit(n).alias("channel"))
        where = part if where is None else where.unionByName(part)
    of = where.groupBy("qid", "chunk_id").agg(F.max(F.col("channel") == "symbol").alias("s"), F.max(F.col("channel") == "bm25").alias("b"))
    hits = best.join(of, ["qid", "chunk_id"]).select("qid", "chunk_id", "score", fusion.source_of(F.col("s"), F.col("b")).alias("source"), F.lit(1).alias("way"))
    if settings.expand:
        near = graph.expand(best, index.edges).select("qid", "chunk_id", "score", F.lit("graph").alias("source"), F.lit(1).alias("way"))
        hits = hits.unionByName(near)
    if settings.use_router:
        named = cut_lineage(routed(alive, queries).select("qid", "chunk_id", "score", F.lit("router").alias("source"), F.lit(0).alias("way")))
        # a query that the router answers goes no further
        hits = hits.join(named.select("qid").distinct(), "qid", "left_anti").unionByName(named)
    rows = hits.join(live, "chunk_id").withColumn("tokens", retrieval_tokens(F.coalesce("code", F.lit(""))))
    packed = packing.pack(rows, settings.budget)
    return packed.join(hits.select("qid", "chunk_id", "source").distinct(), ["qid", "chunk_id"])


def result_rows(results: DataFrame, chunks: DataFrame, with_code: bool = True, snippet: int = 700) -> DataFrame:
    """(qid, place, chunk_id, path, byte_start, byte_end, breadcrumb, score, code): what a reply shows; scores to three
    digits, code cut with a mark."""
    code = F.when(F.length("code") > snippet, F.concat(F.substring("code", 1, snippet), F.lit("\n..."))).otherwise(F.col("code"))
    rows = results.join(chunks.dropDuplicates(["chunk_id"]), "chunk_id").select(
        "qid", "place", "chunk_id", F.col("file_path").alias("path"), "byte_start", "byte_end", "breadcrumb", F.bround("score", 3).alias("score"), code.alias("code")
    )
    return rows if with_code else rows.drop("code")


def replies(rows: DataFrame, budget: int = 1500) -> DataFrame:
    """Result rows that fit a reply of ``budget`` tokens as JSON, in order, with how many were left out."""
    sized = rows.withColumn("row_chars", F.length(F.to_json(F.struct(*[c for c in rows.columns if c != "qid"]))) + 1)
    return rerank.trim_replies(sized, budget).drop("row_chars")
