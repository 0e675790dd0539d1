"""BM25 for batches of queries.

Statistics come first: document frequencies of the terms that are asked for, and
the number and total length of documents, in one pass.  Then every document is
read once more where it lies.  Queries are a bounded block of weights that is
broadcast; in each Arrow batch the documents' saturated term counts meet it in
one product of matrices, and only the k best of a batch leave it.  So no pair of
query and document is shuffled, whatever the number of words they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Queries that are scored in one pass; more are taken in further passes.  Their weights are bounded by their distinct terms.
QUERY_BLOCK = 4096
#: Documents scored together: the product of matrices has this many rows.
ROWS = 512
#: Digits of a score that count: sums of the same parts in another order differ only behind them.
DIGITS = 9


def tokenised(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, tokens) over all text columns of a document together; split once, whatever is made of it."""
    return docs.select(key, F.explode(F.array(search_tokens(F.concat_ws(" ", *texts)))).alias("tokens"))


def postings(docs: DataFrame, key: str, *texts: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl); a document without a term has no row.  ``terms`` (term) keeps only those,
    before anything is shuffled; dl counts all tokens of the document."""
    rows = tokenised(docs, key, *texts).select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


class Statistics:
    """Weights of the asked terms over one collection."""

    def __init__(self, docs: DataFrame, key: str, texts: tuple[str, ...], terms: list[str]):
        held = tokenised(docs, key, *texts).select(F.array_distinct("tokens").alias("t"), F.size("tokens").alias("dl"))
        size = held.agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        self.n, self.average = size["n"], (size["dl"] or 0) / max(1, size["n"])
        asked = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        counted = held.select(F.explode("t").alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("df"))
        idf = {}
        for r in counted.collect():  # at most the terms that are asked for
            x = np.log((self.n - r["df"] + 0.5) / (r["df"] + 0.5))
            idf[r["term"]] = float(x) if x > 0 else FLOOR
        self.idf = idf


def bm25(docs: DataFrame, queries: DataFrame, key: str, *texts: str, k: int = 100, active: DataFrame | None = None, active_on: str | None = None) -> DataFrame:
    """(qid, key, score, rank): the k best documents of every query, higher being better, ties by key.

    A term repeated in the query counts again.  A query without a term, or whose
    terms no document holds, has no row.  Statistics are over all ``docs``, whose
    key must be unique; ``active`` (``active_on``) keeps only documents that it
    lists from being ranked, without changing the statistics.  Scores are
    compared to nine digits.  The queries of a batch are held by the driver and
    broadcast in blocks of QUERY_BLOCK; any number of them is taken.
    """
    spark, kinds = docs.sparkSession, {"qid": dict(queries.dtypes)["qid"], key: dict(docs.dtypes)[key]}
    asked = queries.select("qid", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("q_tf"))
    rows = asked.groupBy("qid").agg(F.collect_list(F.struct("term", "q_tf")).alias("t")).toLocalIterator()
    ranked_docs = docs if active is None else docs.join(active.select(active_on).distinct(), active_on, "left_semi")
    out = None
    while block := [r for _, r in zip(range(QUERY_BLOCK), rows)]:
        terms = sorted({x["term"] for r in block for x in r["t"]})
        part = _score_block(spark, docs, ranked_docs, key, texts, block, Statistics(docs, key, texts, terms), k, kinds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"qid {kinds['qid']}, {key} {kinds[key]}, score double")
    return ranked(out, key, "score", k)


def _score_block(spark, docs, ranked_docs, key, texts, block, stats: Statistics, k: int, kinds) -> DataFrame:
    terms = sorted(stats.idf)
    at = {t: i for i, t in enumerate(terms)}
    cells = [(at[x["term"]], q, x["q_tf"] * stats.idf[x["term"]] * (K1 + 1)) for q, r in enumerate(block) for x in r["t"] if x["term"] in at]
    if not cells:
        return spark.createDataFrame([], f"qid {kinds['qid']}, {key} {kinds[key]}, score double")
    shared = spark.sparkContext.broadcast((terms, np.array(cells), [r["qid"] for r in block]))
    average = stats.average

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sparse, qids = shared.value
        names = pa.array(names)
        # the weights by term: places of queries and their weights
        order = np.argsort(sparse[:, 0], kind="stable")
        term_of, query_of, weight = sparse[order, 0].astype(int), sparse[order, 1].astype(int), sparse[order, 2]
        bounds = np.searchsorted(term_of, np.arange(len(names) + 1))
        common = np.flatnonzero(np.diff(bounds) > 8)  # asked by many: one dense product
        dense_at = np.full(len(names), -1)
        dense_at[common] = np.arange(len(common))
        dense = np.zeros((len(common), len(qids)))
        for n, t in enumerate(common):
            dense[n, query_of[bounds[t] : bounds[t + 1]]] = weight[bounds[t] : bounds[t + 1]]
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                tokens, keys = batch.column("tokens"), batch.column("key")
                lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
                found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(lengths)), lengths)[found >= 0]
                pair, tf = np.unique(doc * len(names) + found[found >= 0], return_counts=True)
                doc, term = np.divmod(pair, len(names))
                part = tf / (tf + K1 * (1 - B + B * lengths[doc] / average))
                x = np.zeros((len(lengths), len(common)))
                is_common = dense_at[term] >= 0
                x[doc[is_common], dense_at[term[is_common]]] = part[is_common]
                scores = x @ dense
                rare_doc, rare_term, rare_part = doc[~is_common], term[~is_common], part[~is_common]
                many = bounds[rare_term + 1] - bounds[rare_term]
                flat = np.repeat(bounds[rare_term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                np.add.at(scores, (np.repeat(rare_doc, many), query_of[flat]), np.repeat(rare_part, many) * weight[flat])
                scores = np.round(scores, DIGITS)
                n = min(k, len(lengths))
                by_key = pc.array_sort_indices(keys).to_numpy()
                scores = scores[by_key]
                d, q = [], []
                for column in range(scores.shape[1]):
                    s = scores[:, column]
                    hit = np.flatnonzero(s > 0)
                    if len(hit) > n:
                        edge = np.partition(s, len(s) - n)[len(s) - n]
                        hit = hit[s[hit] >= edge]
                    hit = hit[np.argsort(-s[hit], kind="stable")[:n]]
                    d.append(hit)
                    q.append(np.full(len(hit), column))
                d, q = np.concatenate(d), np.concatenate(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qids[i] for i in q], batch.schema.field("qkind").type), keys.take(pa.array(by_key[d])), pa.array(scores[d, q])], names=["qid", key, "score"]
                )

    rows = tokenised(ranked_docs, key, *texts).select(F.col(key).alias("key"), "tokens", F.lit(None).cast(kinds["qid"]).alias("qkind"))
    return rows.mapInArrow(run, f"qid {kinds['qid']}, {key} {kinds[key]}, score double")


def ranked(scored: DataFrame, key: str, score: str, k: int | None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Adds rank, from 1, by falling score and rising key within ``by``; keeps the first k."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)
