"""Repetition inside a single document.

:func:`repeated_share` is exact: a word is a repeat if it lies in a run of
``width`` words that also starts earlier.  The JVM drops documents whose window
hashes are all different, which can't have a repeat; the rest are counted word
by word in Arrow batches, without any shuffle.  :func:`divergence` compares
character-class and common-word histograms with those of the whole language by
Jensen-Shannon distance; it ranks odd documents but can't tell which words are
repeats, so it doesn't stand behind the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import window_hashes, with_words

WIDTH, LEAST_WORDS, SHARE = 8, 40, 0.3
COMMON_WORDS = 50


def repeats(words: list[str], width: int = WIDTH) -> int:
    """How many words lie in a run of ``width`` words that also starts earlier."""
    seen: set[str] = set()
    count = upto = 0
    for i in range(len(words) - width + 1):
        run = " ".join(words[i : i + width])
        if run in seen:
            count += i + width - max(i, upto)
            upto = i + width
        else:
            seen.add(run)
    return count


def repeated_share(documents: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_repeats) of documents of at least ``least_words`` words with any repeat.

    Null and shorter texts give no row; copies of a row come out once.
    """
    docs = with_words(documents, "doc_id").where(F.size("w") >= max(least_words, width))
    hashes = docs.select("doc_id", "w", F.explode(F.array(window_hashes("w", width))).alias("h"))
    suspects = hashes.where(F.size(F.array_distinct("h")) < F.size("h")).select("doc_id", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(w), repeats(w, width)) for w in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())],
                names=["doc_id", "n_words", "n_repeats"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return suspects.mapInArrow(run, f"doc_id {kind}, n_words int, n_repeats int").where("n_repeats > 0").distinct()


def repetitive(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id) of documents in which at least ``share`` of the words are repeats."""
    per_mille = round(share * 1000)
    return repeated_share(documents).where(F.col("n_repeats") * 1000 >= F.col("n_words") * per_mille).select("doc_id")


_CLASSES = {"upper": r"\p{Lu}", "letter": r"\p{L}", "digit": r"\p{N}", "space": r"\s", "punct": r"\p{P}"}


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""

    def half(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(x * 2 / (x + y))).otherwise(F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    return F.sqrt(F.greatest(F.lit(0.0), (half(p, q) + half(q, p)) / 2))


def divergence(documents: DataFrame, least_words: int = LEAST_WORDS, common: int = COMMON_WORDS) -> DataFrame:
    """(doc_id, lang, js_chars, js_words) of documents of at least ``least_words`` words.

    References are the shares over all documents of a language (lower-cased,
    null being ''); the common words are the ``common`` most frequent of it.
    """
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit(""))
    docs = with_words(documents.withColumn("lang", lang), "doc_id", "lang", "text").where(F.size("w") >= least_words)
    letters = [F.regexp_count("text", F.lit(f"(?U){rx}")).cast("double") for rx in _CLASSES.values()]
    rest = F.length("text") - F.aggregate(F.slice(F.array(*letters), 2, 4), F.lit(0.0), lambda s, v: s + v)
    letters[1] = letters[1] - letters[0]
    chars = docs.select("doc_id", "lang", "w", F.array(*letters, rest.cast("double")).alias("c"))
    tallies = chars.select("lang", F.posexplode("c").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    counts = chars.select("lang", F.explode("w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    all_words = counts.groupBy("lang").agg(F.sum("n").alias("all_n"))
    ref_words = top.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("t")
    ).join(all_words, "lang")
    ref_chars = tallies.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("rc")
    )
    share = lambda a: F.transform(a, lambda x: x / F.greatest(F.lit(1e-12), F.aggregate(a, F.lit(0.0), lambda s, v: s + v)))
    ref = ref_words.join(ref_chars, "lang").select(
        "lang",
        F.transform("t", lambda x: x["word"]).alias("top_words"),
        F.transform("t", lambda x: x["n"] / F.col("all_n")).alias("rw"),
        share(F.col("rc")).alias("rc"),
    )
    joined = chars.join(ref, "lang")  # one row per language, so the smaller side by far
    mine = F.transform(
        "top_words", lambda t: F.size(F.filter("w", lambda x: x == t)) / F.size("w").cast("double")
    )
    tail = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, v: s + v))))
    return joined.select(
        "doc_id",
        "lang",
        F.round(_js(share(F.col("c")), F.col("rc")), 6).alias("js_chars"),
        F.round(_js(tail(mine), tail(F.col("rw"))), 6).alias("js_words"),
    )
