"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import leaks, neighbours, origin, repetition, secrets, split, tokenizer
from tessera.llm.syntax import files as syntax
from tessera.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(table(spark, folder, "chunks", "chunk_id", "byte_start", "code"))


def p1_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces with the least total of cut penalties and size imbalance, with their breadcrumb."""
    chunks = table(spark, folder, "chunks", "chunk_id", "byte_start", "code", "breadcrumb")
    return split.split_oversized(chunks, objective="total", label_col="breadcrumb")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return origin.not_hand_written(*_origin_tables(spark, folder))


def p4_origins(spark: SparkSession, folder: str) -> DataFrame:
    """Blobs and bytes by language and origin."""
    found = origin.file_origin(*_origin_tables(spark, folder))
    return found.groupBy("language", "origin").agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"))


def _origin_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, folder, "chunks", "blob_hash", "byte_start", "byte_end", "language", "code"),
        table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, folder, "chunk_vectors", "chunk_id", "model", "dim", "vector"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.tainted_files(_whole(spark, folder)).select("blob_hash")


def p6_errors(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.unparsed_files(_whole(spark, folder))


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.unparsed_rates(_whole(spark, folder), table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at"))


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "blob_hash", "byte_start", "language", "code")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "code", "language")
    return secrets.find_credentials(chunks).select("chunk_id", "line_no").distinct()


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.redact(table(spark, folder, "chunks", "chunk_id", "code", "language"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the ids give back."""
    return tokenizer.decode(p8_ids(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_spans(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p9_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.scrub(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(table(spark, folder, "documents", "doc_id", "text"))


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repeated_share(table(spark, folder, "documents", "doc_id", "text"))


def p10_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.divergence(table(spark, folder, "documents", "doc_id", "text", "lang"))


QUERIES = {
    "p1_found": p1_found,
    "p1_balanced": p1_balanced,
    "p4_found": p4_found,
    "p4_origins": p4_origins,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_errors": p6_errors,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p9_scrubbed": p9_scrubbed,
    "p10_found": p10_found,
    "p10_share": p10_share,
    "p10_divergence": p10_divergence,
}

_WORDS = r"string_split(lower(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ')), ' ')"

P9_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
grams AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)
), dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g
  FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)
)
SELECT DISTINCT doc_id, item_id FROM wins JOIN grams USING (g)
"""

P10_CORE = f"""
WITH dw AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
wins AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 40
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS rn FROM wins) WHERE rn > 1
), covered AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(8) t(k)),
shares AS (
  SELECT doc_id, CAST(max(len(w)) AS INTEGER) AS n_words, CAST(count(*) AS INTEGER) AS n_repeats
  FROM covered JOIN dw USING (doc_id) GROUP BY doc_id
)
"""

P9_SPANS_SQL = (
    P9_SQL[: P9_SQL.rindex("SELECT DISTINCT")].replace("SELECT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g", "SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 11), ' ') AS g").rstrip()
    + """, hits AS (SELECT DISTINCT doc_id, item_id, pos FROM wins JOIN grams USING (g)),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER o > 12 OR lag(pos) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM hits WINDOW o AS (PARTITION BY doc_id, item_id ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS run FROM marked)
SELECT doc_id, item_id, CAST(min(pos) AS INTEGER) AS first_word, CAST(max(pos) + 11 AS INTEGER) AS last_word FROM runs GROUP BY doc_id, item_id, run"""
)

SQL = {
    "p8_decoded": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_spans": P9_SPANS_SQL,
    "p9_found": P9_SQL,
    "p10_found": P10_CORE + "SELECT doc_id FROM shares WHERE n_repeats * 10 >= n_words * 3",
    "p10_share": P10_CORE + "SELECT doc_id, n_words, n_repeats FROM shares",
}
