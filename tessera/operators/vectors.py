"""Dense vectors: normalising, exact top-k in blocks, and the encoder hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexical import ranked

QUERY_BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """(qid, key, score, rank): the k rows of greatest dot product of every query (qid, vector), ties by key.

    Rows stay where they lie; blocks of QUERY_BLOCK queries are broadcast one after
    another and meet every batch of rows as one matrix product (that is the work of
    exact search), and only k rows a query leave a batch.  Vectors of another
    length than the query's are passed over; null vectors are left out.
    """
    spark = vectors.sparkSession
    kinds = {"qid": dict(queries.dtypes)["qid"], "key": dict(vectors.dtypes)[key]}
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), F.lit(None).cast(kinds["qid"]).alias("qid"))
    asked = queries.where(F.col(vector).isNotNull()).select("qid", F.col(vector).alias("v")).toLocalIterator()
    found = None
    while block := [r for _, r in zip(range(QUERY_BLOCK), asked)]:
        by_dim: dict[int, tuple[list, list]] = {}
        for r in block:
            ids, values = by_dim.setdefault(len(r["v"]), ([], []))
            ids.append(r["qid"])
            values.append(r["v"])
        shared = spark.sparkContext.broadcast({d: (ids, np.array(values, np.float64)) for d, (ids, values) in by_dim.items()})
        part = rows.mapInArrow(_nearest_rows(shared, k, exclude_self), f"qid {kinds['qid']}, key {kinds['key']}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"qid {kinds['qid']}, key {kinds['key']}, score double")
    return ranked(found, "key", "score", k).withColumnRenamed("key", key)


def _nearest_rows(shared, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("qid").type, batch.schema.field("key").type, pa.float64()]
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim, (ids, mat) in shared.value.items():
                at = np.flatnonzero(lengths == dim)
                if not len(at):
                    continue
                rows = batch.take(pa.array(at))
                x = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                names = np.array(rows.column("key").to_pylist(), dtype=object)
                order = np.argsort(names, kind="stable")
                names, sims = names[order], np.round(mat @ x[order].T, 6)
                out = [], [], []
                for i, q in enumerate(ids):
                    best = np.argsort(-sims[i], kind="stable")[: k + 1]
                    best = [j for j in best if not exclude_self or names[j] != q][:k]
                    out[0].extend([q] * len(best))
                    out[1].extend(names[best])
                    out[2].extend(sims[i][best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["qid", "key", "score"])

    return run


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks without a vector."""
    return chunks.join(vectors.where("vector is not null").select("chunk_id"), "chunk_id", "left_anti")


def embed(chunks: DataFrame, known: DataFrame, encode: Callable[[list[str]], list[list[float]]], prefix: str = "", most_chars: int = 8192) -> DataFrame:
    """(chunk_id, vector) of chunks that ``known`` lacks: breadcrumb and code, cut, behind the prefix, normalised.

    ``encode`` takes and gives a batch; equal texts are encoded once.
    """
    text = F.concat(F.lit(prefix), F.substring(F.concat_ws("\n", "breadcrumb", "code"), 1, most_chars))
    todo = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", text.alias("text"))
    distinct = todo.select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            v = encode(texts)
            if len(v) != len(texts):
                raise ValueError("the encoder gave another number of vectors than texts")
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(v, pa.list_(pa.float32()))], names=["text", "raw"])

    encoded = distinct.mapInArrow(run, "text string, raw array<float>")
    return todo.join(encoded, "text").select("chunk_id", normalised(F.col("raw")).cast("array<float>").alias("vector"))
