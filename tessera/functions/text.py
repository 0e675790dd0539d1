"""Expressions on identifiers, queries and code text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case letters that are a Latin letter with marks, that letter, and - without counterpart, so that they go - the marks."""
    pairs = []
    for code in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and base.isalpha() and c == c.lower() and all(unicodedata.combining(m) for m in marks):
            pairs.append((c, base))
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


_ACCENTED, _FOLDED = _accents()
#: Endings by which a bare name counts as that of a source file.
FILE_SUFFIXES = "go|py|ts|tsx|js|jsx|mjs|cjs|proto"
LEAST_NAME, LEAST_PATH = 3, 4


def search_tokens(text: Column) -> Column:
    """Case- and accent-folded runs of letters, numbers and underscores, with repeats."""
    low = F.lower(text)
    folded = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED, _FOLDED))  # ASCII has nothing to fold
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def split_identifier(token: Column) -> Column:
    """The lower-case words of a name: it is cut at what is no letter or digit, before a capital behind a small
    letter or digit, before the last capital of a run that goes on in small letters, and between capital and digit."""
    cuts = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Z])(?=[0-9])"
    return F.filter(F.split(F.lower(F.regexp_replace(token, cuts, " ")), "[^a-z0-9]+"), lambda w: w != "")


def _names(query: Column) -> Column:
    """ASCII words that can be names, in order: digits in front do not belong to one."""
    words = F.transform(F.split(query, "[^A-Za-z0-9_]+"), lambda w: F.ltrim(w, F.lit("0123456789")))
    return F.filter(words, lambda w: F.length(w) >= LEAST_NAME)


def identifier_tokens(query: Column) -> Column:
    """The tokens of a query that are written like code, in order, once each.

    At least three characters, and an underscore, a digit, a capital behind the
    first character, a place where only code stands (called, after a dot or colon,
    alone in brackets), or alone in the query.
    """
    spaced = F.regexp_replace(query, r"\s+\(", "(")
    shaped = F.concat(*[F.regexp_extract_all(spaced, F.lit(rx), F.lit(0)) for rx in (r"\w+(?=\()", r"(?<=[.:])\w+", r"(?<=\()\*?\w+(?=\))")])
    placed = F.transform(shaped, lambda w: F.ltrim(w, F.lit("*0123456789")))
    tail = lambda t: F.substring(t, F.lit(2), F.length(t))
    written = lambda t: F.contains(t, F.lit("_")) | (F.translate(t, "0123456789", "") != t) | (tail(t) != F.lower(tail(t)))
    return F.array_distinct(F.filter(_names(query), lambda t: written(t) | F.array_contains(placed, t) | (t == F.trim(query))))


def path_segments(query: Column) -> Column:
    """Paths and bare source file names in a query, at least four characters, once each.

    A path is a run of path characters with a slash inside; doubled slashes end it.
    """
    runs = F.flatten(F.transform(F.split(query, r"[^A-Za-z0-9_./\-]+"), lambda r: F.split(r, "//+")))
    trimmed = F.transform(runs, lambda r: F.rtrim(F.trim(r, F.lit("/")), F.lit(".")))
    named = F.transform(trimmed, lambda r: F.when(F.contains(r, F.lit("/")), r).otherwise(F.regexp_extract(r, rf"([^.]+\.(?:{FILE_SUFFIXES}))(?:[.-].*)?$", 1)))
    return F.array_distinct(F.filter(named, lambda r: F.length(r) >= LEAST_PATH))


def query_terms(query: Column) -> Column:
    """Lower-cased names together with their words, of three letters or more, sorted, once each."""
    names = _names(query)
    words = F.flatten(F.transform(names, split_identifier))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.transform(names, F.lower), words), lambda t: F.length(t) >= LEAST_NAME)))


def retrieval_tokens(text: Column) -> Column:
    """Estimate used for packing: a quarter of the characters, rounded up, and a quarter of the line breaks."""
    quarter = F.ceil(F.length(text) / 4)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.greatest(F.lit(1), quarter + F.floor(breaks / 4)).cast("int")


def tool_tokens(text: Column) -> Column:
    """Estimate used in tool replies: a quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")
