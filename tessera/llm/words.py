"""Words as the text operators count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def lower_words(text: Column) -> Column:
    """The longest runs of letters, numbers and underscores, lower-cased after they are cut."""
    return F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " ")), " ")


def with_words(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., w): the words of every row with a text.

    The one-element explode keeps the optimizer from copying the splitting into
    later expressions, where lambdas would run it once for every element.
    """
    return df.where(F.col(text).isNotNull()).select(*keep, F.explode(F.array(lower_words(F.col(text)))).alias("w"))


def window_hashes(words: str, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words of an array column; empty for shorter arrays."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(F.col(words), i, width)))
    return F.when(n >= width, hashes).otherwise(F.array().cast("array<bigint>"))
