"""Evaluation texts leaking into training text.

The word n-grams of the evaluation items form a hash set that is broadcast
within a checked bound.  Documents are cut into blocks of words that overlap by
a window less one; each window of a block is looked up by its hash, and a hit
counts only if the words themselves are equal.  A window carries its own words
and nothing else of its document, so the work is linear in a text's length and
nothing is shuffled.  Beyond the bound only hashes are shuffled, and hits are
verified by joining them back to their texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import with_words

WIDTH = 12
#: Distinct n-grams up to which the set is broadcast (about 150 bytes each).
BROADCAST_GRAMS = 500_000
#: Words of a block; bounds what one row holds, whatever the length of a text.
BLOCK = 2048


def _blocks(words: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep..., first, b): blocks of ``w`` that together hold every window of ``width`` words once."""
    starts = F.sequence(F.lit(1), F.size("w") - (width - 1), F.lit(BLOCK))
    cut = F.transform(starts, lambda i: F.struct((i - 1).alias("first"), F.slice("w", i, BLOCK + width - 1).alias("b")))
    return words.where(F.size("w") >= width).select(*keep, F.explode(cut).alias("_s")).select(*keep, "_s.first", "_s.b")


def _windows(blocks: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep..., at, run): the words of every window, joined by blanks, and the place of its first word in the text."""
    runs = F.transform(F.sequence(F.lit(1), F.size("b") - (width - 1)), lambda i: F.array_join(F.slice("b", i, width), " "))
    return blocks.select(*keep, "first", F.posexplode(runs).alias("_k", "run")).select(*keep, (F.col("first") + F.col("_k")).alias("at"), "run")


def _hash(run: Column | str) -> Column:
    return F.xxhash64(run)


def item_grams(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(gram, words, item_id): the distinct n-grams of the items; words hold no blank, so a joined run is unambiguous."""
    runs = _windows(_blocks(with_words(items, "item_id"), width, "item_id"), width, "item_id")
    return runs.select(_hash("run").alias("gram"), F.col("run").alias("words"), "item_id").distinct()


def leak_hits(documents: DataFrame, items: DataFrame, width: int = WIDTH, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, item_id, at): document windows (``at`` is their first word, from 0) that an item holds."""
    grams = item_grams(items, width)
    docs = with_words(documents, "doc_id")
    if grams.limit(most + 1).count() <= most:
        runs = _windows(_blocks(docs, width, "doc_id"), width, "doc_id").withColumn("gram", _hash("run"))
        return runs.join(F.broadcast(grams), "gram").where(F.col("run") == F.col("words")).select("doc_id", "item_id", "at")
    # too many for a broadcast: hashes meet first, then the few hits meet their texts
    key = F.xxhash64("w")
    joined = F.transform(F.sequence(F.lit(1), F.size("b") - (width - 1)), lambda i: _hash(F.array_join(F.slice("b", i, width), " ")))
    prints = docs.withColumn("print", key)
    hashed = _blocks(prints, width, "doc_id", "print").select("doc_id", "print", "first", F.posexplode(joined).alias("_k", "gram"))
    hits = hashed.select("doc_id", "print", (F.col("first") + F.col("_k")).alias("at"), "gram").join(grams, "gram").distinct()
    per = hits.groupBy("doc_id", "print").agg(F.collect_list(F.struct("at", "item_id", "words")).alias("hits"))
    met = prints.join(per, ["doc_id", "print"])
    sure = F.filter("hits", lambda h: F.array_join(F.slice("w", h["at"] + 1, width), " ") == h["words"])
    return met.select("doc_id", F.explode(sure).alias("h")).select("doc_id", "h.item_id", "h.at")


def leaked(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id) of every document that holds ``width`` consecutive words of an item.

    Null, empty and shorter texts on either side never match.  Copies of a row
    count once.  Items that share a passage are all reported.
    """
    return leak_hits(documents, items, width).select("doc_id", "item_id").distinct()


def leak_spans(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): maximal runs of leaked words, from 0."""
    hits = leak_hits(documents, items, width).distinct()
    order = Window.partitionBy("doc_id", "item_id").orderBy("at")
    new = (F.col("at") - F.lag("at").over(order) > width) | F.lag("at").over(order).isNull()
    runs = hits.withColumn("run", F.sum(new.cast("int")).over(order))
    return runs.groupBy("doc_id", "item_id", "run").agg(
        F.min("at").alias("first_word"), (F.max("at") + width - 1).alias("last_word")
    ).drop("run")


_WORD_RE = re.compile(r"\w+")


def scrub(documents: DataFrame, items: DataFrame, width: int = WIDTH, whole: bool = False) -> DataFrame:
    """The documents without leaked text: ``whole`` drops the documents, else only the spans go.

    Clean documents pass through untouched; a document id must stand for one text.
    """
    if whole:
        return documents.join(leaked(documents, items, width).select("doc_id").distinct(), "doc_id", "left_anti")
    spans = leak_spans(documents, items, width).groupBy("doc_id").agg(
        F.collect_set(F.struct("first_word", "last_word")).alias("_spans")
    )

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, runs) -> str:
            words = [m.span() for m in _WORD_RE.finditer(t)]
            for r in sorted(runs, key=lambda r: -r["first_word"]):
                t = t[: words[r["first_word"]][0]] + t[words[min(r["last_word"], len(words) - 1)][1] :]
                words = [m.span() for m in _WORD_RE.finditer(t)]
            return t

        def merged(runs):
            out: list[dict] = []
            for r in sorted(runs, key=lambda r: r["first_word"]):
                if out and r["first_word"] <= out[-1]["last_word"] + 1:
                    out[-1]["last_word"] = max(out[-1]["last_word"], r["last_word"])
                else:
                    out.append(dict(r))
            return out

        return pd.Series([one(t, merged(r)) for t, r in zip(text, spans)])

    marked = documents.join(spans, "doc_id", "left")
    hit = marked.where("_spans is not null").withColumn("text", cut("text", "_spans")).drop("_spans")
    return marked.where("_spans is null").drop("_spans").unionByName(hit)
