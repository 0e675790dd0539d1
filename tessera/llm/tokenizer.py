"""Encoding a corpus with a public byte-level BPE vocabulary.

Spark splits every text into the words that the vocabulary's pattern defines,
each distinct word is encoded once, and ids come back by a join on the word and
are put in order by position.  Decoding is a join of ids with the pieces of the
vocabulary file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed by the vocabulary: its splitting pattern. (?U) gives \s and \S the Unicode meaning it was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word with more than this share of all words is hot, so at most 1 / HOT_SHARE words are ...
HOT_SHARE = 2e-6
#: ... and none longer than this many bytes: the broadcast table of hot words is bounded at any input.
HOT_BYTES = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_words(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, n, ids) of a table (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            enc = enc or _encoding(path)
            ids = [enc.encode_ordinary(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"]
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


def _once(docs: DataFrame, key: str) -> DataFrame:
    """Copies of a row once.  Only rows whose key occurs again are compared as a whole."""
    again = cut_lineage(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_again")))
    if again.isEmpty():
        return docs
    same = F.col(key).eqNullSafe(F.col("_again"))
    return docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").distinct())


def encode(documents: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row per distinct (id, text).

    Null and empty texts have the empty list.  Strings that look like special
    tokens are ordinary text; nothing is trimmed or normalised.  A document is
    one row of the result, so its words meet in one task, however long it is.

    Every distinct word is encoded once.  Hot words, whose number their share
    bounds, are broadcast and take their places as a document streams by; only
    the others are shuffled, to the word table and back to their document.
    """
    spark = documents.sparkSession
    docs = _once(documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id")
    words = words_of(F.coalesce("_text", F.lit("")))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocab = cut_lineage(encode_words(counted, path))
    total = vocab.agg(F.sum("n")).first()[0] or 0
    is_hot = (F.col("n") > HOT_SHARE * total) & (F.octet_length("word") <= HOT_BYTES)
    hot = vocab.where(is_hot).select("word", "ids").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(hot)
    hole = pa.struct([("k", pa.int32()), ("at", pa.int32()), ("word", pa.string())])
    kind = dict(docs.dtypes)["_id"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = (c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in (shared.value.column(n) for n in ("word", "ids")))
        for batch in batches:
            w = batch.column("w")
            flat, bounds = w.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(w).to_numpy(zero_copy_only=False))))
            found = pc.index_in(flat, value_set=names)
            lists = ids.take(found)
            upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            rare = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
            of = np.searchsorted(bounds, rare, "right") - 1  # the document of each rare word
            firsts = np.searchsorted(of, np.arange(len(w) + 1))
            start = upto[bounds[:-1]]
            holes = pa.StructArray.from_arrays(
                [pa.array(rare - bounds[of], pa.int32()), pa.array(upto[rare] - start[of], pa.int32()), flat.take(pa.array(rare))], fields=list(hole)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.ListArray.from_arrays(pa.array(upto[bounds], pa.int32()), lists.flatten()), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), holes)],
                names=["_key", "ids", "holes"],
            )

    # a key that is never null and readings that take all columns: one exchange serves both, so texts are split and looked up once
    ddl = f"_key struct<id:{kind},print:long> not null, ids array<int>, holes array<struct<k:int,at:int,word:string>>"
    key = F.struct(F.col("_id").alias("id"), F.xxhash64("_text").alias("print"))
    placed = docs.select(key.alias("_key"), words.alias("w")).mapInArrow(fill, ddl).repartition("_key")
    lost = placed.select(F.col("_key").alias("_of"), F.explode_outer(F.when(F.size("ids") >= 0, F.col("holes"))).alias("h")).where("h is not null")
    rare = vocab.where(~is_hot).select("word", F.col("ids").alias("piece"))
    fills = (
        lost.select("_of", "h.k", "h.at", "h.word").join(rare, "word")
        .groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("k", "at", "piece"))).alias("f"))
    )
    whole = placed.join(fills, F.col("_key") == F.col("_of"), "left")
    before = lambda i: F.coalesce(F.get(F.col("f"), i - 1)["at"], F.lit(0))
    parts = F.transform("f", lambda x, i: F.concat(F.slice("ids", before(i) + 1, x["at"] - before(i)), x["piece"]))
    last = F.element_at("f", -1)["at"]
    mended = F.concat(F.flatten(parts), F.slice("ids", last + 1, F.size("ids") - last))
    return whole.select(F.col("_key.id").alias(id_col), F.when(F.size("holes") == 0, F.col("ids")).otherwise(mended).alias("ids"))


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, piece) of the vocabulary file; about 50,000 rows, fixed."""
    line = F.split("value", " ")
    return spark.read.text(f"file://{path}").select(
        F.element_at(line, 2).cast("int").alias("id"), F.unbase64(F.element_at(line, 1)).alias("piece")
    )


def decode(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); a list without ids gives the empty text."""
    pieces = F.broadcast(vocabulary(encoded.sparkSession, path))
    rows = encoded.select(id_col, F.posexplode_outer("ids").alias("at", "id"))
    joined = rows.join(pieces, "id", "left").groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.hex("piece").alias("h"))))).alias("seq")
    )
    return joined.select(id_col, F.unhex(F.array_join(F.transform("seq", lambda x: x["h"]), "")).cast("string").alias("text"))
