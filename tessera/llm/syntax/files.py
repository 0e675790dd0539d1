"""Source files that do not parse: whole files from their chunks, and the operator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunking import joined, placed_chunks
from tessera.operators.snapshots import snapshot_records

LANGUAGES = ("python", "javascript", "typescript", "go", "proto")
#: Rows of a batch of results.
MOST_ROWS = 1000


#: Reasons that say that a file could not be judged; such files are neither valid nor tainted.
UNJUDGED = ("gap", "limit")


class Parsers:
    """One parser per language, made when a worker first needs it."""

    def __init__(self):
        self.made: dict = {}

    def _of(self, language: str):
        if language not in self.made:
            from tessera.llm.syntax.lexers import MAKERS

            self.made[language] = MAKERS[language]()
        return self.made[language]

    def first_error(self, language: str, text: str) -> tuple[int, str] | None:
        """(line, reason) of the first error, None for a valid text; ``limit`` if memory ends before the text."""
        parser = self._of(language)
        try:
            return None if parser.valid(text) else parser.first_error(text)
        except (RecursionError, MemoryError):
            self.made.pop(language)
            return 1, "limit"


def unparsed_files(chunks: DataFrame) -> DataFrame:
    """(blob_hash, language, line, reason) of the files with a syntax error in their language, or that can't be judged.

    ``line`` is where the first error was met, ``reason`` what met it: token,
    bracket or grammar; ``gap`` if chunks leave a part of the file out and
    ``limit`` if a worker's memory does not do for it, which say nothing about
    validity.  Language text and unknown languages are never cases; empty files
    are valid; null code, hash or place gives no row; copies of a chunk row count
    once.  Chunks of a blob come to one task sorted by place and are joined as
    they stream by; no group is held but the file being joined.
    """
    schema = pa.schema([("blob_hash", pa.string()), ("language", pa.string()), ("line", pa.int32()), ("reason", pa.string())])
    parsers = Parsers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        held: tuple | None = None  # the first run of a blob, until it is known to be the only one

        def judge(blob: str, language: str, data: bytes | None) -> None:
            error = (1, "gap") if data is None else parsers.first_error(language, data.decode("utf-8", "replace"))
            if error is not None:
                rows.append((blob, language, *error))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for key, lang, start, data in joined(batches):
            if start > 0:
                held = (key, lang, None)
                continue
            if held:
                judge(*held)
            held = (key, lang, data)
            if len(rows) >= MOST_ROWS:
                yield made()
                rows.clear()
        if held:
            judge(*held)
        if rows:
            yield made()

    return placed_chunks(chunks.where(F.col("language").isin(*LANGUAGES))).mapInArrow(run, "blob_hash string, language string, line int, reason string")


def tainted_files(chunks: DataFrame) -> DataFrame:
    """(blob_hash, language) of the files that are not valid in their language."""
    return unparsed_files(chunks).where(~F.col("reason").isin(*UNJUDGED)).select("blob_hash", "language")


def unparsed_rates(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_tainted): files of each repository by blob, and those that don't parse."""
    held = snapshot_records(files).select("repo", "blob_hash").distinct()
    languages = chunks.where(F.col("language").isin(*LANGUAGES)).select(F.lower("blob_hash").alias("blob_hash"), "language").distinct()
    bad = tainted_files(chunks).select("blob_hash", F.lit(1).alias("bad"))
    return (
        held.join(languages, "blob_hash")
        .join(bad, "blob_hash", "left")
        .groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.count("bad").alias("n_tainted"))
    )
