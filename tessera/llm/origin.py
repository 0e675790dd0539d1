"""Generated, minified, vendored and data files among source files.

Layout statistics are taken of every chunk in Arrow batches (one pass, columns
pruned to what is read) and added up per blob, so only a few numbers a chunk are
shuffled.  Thresholds on them, tuned per language, tell minified scripts, data
saved as code and machine-written repetition; notes in the head of a file and
its place in the tree tell tool output and third-party copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.snapshots import snapshot_records

#: Notes count in what a file has before its first line of code: comments of any number and length, and a docstring.
_DOC = rb"[rRuU]?\"\"\"[\s\S]*?(?:\"\"\"|\Z)|[rRuU]?'''[\s\S]*?(?:'''|\Z)"
_LEADING = re.compile(rb"(?:\xef\xbb\xbf)?(?:[ \t\r\n]+|(?://|#|--)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|" + _DOC + rb"|['\"]use strict['\"];?)*+")
_COMMENT = rb"(?m)^[ \t]*(?://|#|/\*+|\*|<!--|--|[rRuU]?\"\"\"|[rRuU]?''')?[ \t]*"
TOOL_NOTE = re.compile(
    _COMMENT
    + rb"(?:[^\n]*@generated\b|</?auto-?generated|auto-?generated\b"
    rb"|[^\n]{0,40}\bcode generated by\b[^\n]*\bdo not (?:edit|modify)"
    rb"|(?:this file|this code|this module)[^\n]{0,30}\b(?:was|is|has been) (?:automatically|auto-?)[ -]?(?:generated|created|written)"
    rb"|(?:this file|this code) (?:was|is) generated\b"
    rb"|automatically generated by \S"
    rb"|machine-(?:written|generated|made)\b"
    rb"|do not (?:modify|edit)[!.,: ][^\n]*\b(?:output|generated|produced)\b"
    rb"|(?:output|generated|produced|written) (?:of|by) [^\n]*\b(?:do not|don't) (?:edit|modify)"
    rb"|fichier (?:produit|g\xc3\xa9n\xc3\xa9r\xc3\xa9|genere)\b[^\n]*ne pas modifier"
    rb"|diese datei wurde automatisch\b)",
    re.I,
)
COPY_NOTE = re.compile(
    _COMMENT
    + rb"(?:vendored:[ \t]*\S+@\d"
    rb"|copied (?:unchanged |verbatim )?from \S+ v?\d+\.\d+[^\n]*\bupstream\b"
    rb"|(?:vendored|copied verbatim|copied unchanged) from https?://"
    rb"|copied from [\w.@/-]+ v?\d+\.\d+\.\d+\b"
    rb"|imported unchanged from\b"
    rb"|origin:[ \t]*https?://\S+[^\n]*(?:\btag\b|@)"
    rb"|\S+ v\d+\.\d+\.\d+[ \t]*\r?\n[^\n]*\(c\)[ \t]*\d{4}[^\n]* the (?!authors of this repository)[^\n]*(?:contributors|authors))",
    re.I,
)
#: A third-party tree: a package folder below one of these at the root, anywhere below
#: the unambiguous ones, or any folder named after a package with its version.
VENDOR_PLACE = (
    r"(?i)^(vendor|third_party|third-party|node_modules|bower_components|pods)/[^/]+/"
    r"|(^|/)(node_modules|bower_components|site-packages|_vendor|3rdparty)/[^/]+/"
    r"|(^|/)[a-z][a-z0-9_.-]*-v?\d+\.\d+\.\d+/"
)
#: Fixed names of lock files.
LOCK_NAMES = r"(?i)(^|/)(copy_|old_)?(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|uv\.lock)$"

LONG_LINE = 200
#: Minified: least share of bytes in long lines with at most this share of white space; or, for a bundle that
#: is wrapped, a mean and a longest line of at least so many bytes with at most that share of white space and
#: at least that of letters and digits.
MINIFIED = {"javascript": (0.5, 0.08), "typescript": (0.5, 0.08)}
MINIFIED_ELSE = (0.5, 0.08)
WRAPPED = {"javascript": (70, 100, 0.05, 0.5), "typescript": (70, 100, 0.05, 0.5)}
WRAPPED_ELSE = (90, 120, 0.04, 0.5)
#: Least share of bytes in encoded runs, and in numeric literals, by language: data saved as code.
ENCODED_SHARE, ENCODED_RUN = 0.75, 40
NUMBER_SHARE = {"javascript": 0.085, "typescript": 0.085}
NUMBER_SHARE_ELSE = 0.4
#: A table of records also repeats its line shape this often where NUMBER_SHARE is low.
TABLE_REPEAT = 0.35
#: Least share of lines with the shape of one of the six lines before: written by a tool.
REPEAT_SHARE = {"go": 0.8}
REPEAT_SHARE_ELSE = 0.74
REPEAT_LINES = 12
LOCK_SHARE = 0.4

_IDENT = re.compile(rb"[A-Za-z_][A-Za-z_0-9]*")
_DIGITS = re.compile(rb"0x[0-9a-fA-F]+|\d+(?:\.\d+)?")
_NUMBER = re.compile(rb"(?<![A-Za-z_0-9.])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)")
_RUN = re.compile(rb"[A-Za-z0-9+/=]{%d,}" % ENCODED_RUN)
_LOCK = re.compile(rb"(?m)^[ \t]*\"?(?:integrity|resolved|checksum)\"?:?[ \t]")
_STATS = ("bytes", "lines", "spaces", "long_bytes", "number_bytes", "run_bytes", "repeats", "locks", "alnum", "longest")
_ALNUM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))


def layout(data: bytes, repeats: bool = True) -> tuple[int, ...]:
    """The values of _STATS for one piece of text."""
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    again = 0
    if repeats and len(lines) > 1:
        shapes = _DIGITS.sub(b"0", _IDENT.sub(b"a", b"\n".join(lines))).split(b"\n")
        again = sum(x in shapes[max(0, i - 6) : i] for i, x in enumerate(shapes))
    return (
        len(data),
        len(lines),
        len(data) - len(data.translate(None, b" \t\r\n")),
        sum(n for n in map(len, lines) if n > LONG_LINE),
        sum(map(len, _NUMBER.findall(data))),
        sum(map(len, _RUN.findall(data))),
        again,
        len(_LOCK.findall(data)),
        len(data) - len(data.translate(None, _ALNUM)),
        max(map(len, lines), default=0),
    )


def head_notes(data: bytes) -> tuple[bool, bool]:
    """(tool output, third-party copy) by what stands before the first line of code."""
    head = _LEADING.match(data)[0]
    return bool(TOOL_NOTE.search(head)), bool(COPY_NOTE.search(head))


def chunk_layout(chunks: DataFrame) -> DataFrame:
    """(blob_hash, byte_start, byte_end, language, statistics, tool_note, copy_note) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("code").cast(pa.binary())
            first = batch.column("byte_start").to_pylist()
            langs = batch.column("language").to_pylist()
            rows = [
                (*layout(t.as_py(), lang != "proto"), *(head_notes(t.as_py()) if at == 0 else (False, False)))
                for t, at, lang in zip(texts, first, langs)
            ]
            cols = list(zip(*rows)) or [[]] * (len(_STATS) + 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("blob_hash", "byte_start", "byte_end", "language")]
                + [pa.array(c, pa.int64()) for c in cols[:-2]]
                + [pa.array(c, pa.bool_()) for c in cols[-2:]],
                names=["blob_hash", "byte_start", "byte_end", "language", *_STATS, "tool_note", "copy_note"],
            )

    wanted = chunks.where("code is not null and blob_hash is not null").select(
        F.lower("blob_hash").alias("blob_hash"), F.col("byte_start").cast("long"), F.col("byte_end").cast("long"), "language", "code"
    )
    ddl = "blob_hash string, byte_start long, byte_end long, language string, "
    return wanted.mapInArrow(run, ddl + ", ".join(f"{s} long" for s in _STATS) + ", tool_note boolean, copy_note boolean")


def places(files: DataFrame) -> DataFrame:
    """(blob_hash, vendor_place, lock_name): whether any snapshot record puts the blob there."""
    where = snapshot_records(files).select("blob_hash", "path")
    return where.groupBy("blob_hash").agg(
        F.max(F.col("path").rlike(VENDOR_PLACE)).alias("vendor_place"), F.max(F.col("path").rlike(LOCK_NAMES)).alias("lock_name")
    )


def _by_language(limits: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for lang, v in limits.items():
        out = F.when(F.col("language") == lang, v).otherwise(out)
    return out


def file_origin(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(blob_hash, language, statistics, origin) of every blob behind a path.

    ``origin`` is tool, copy, minified, data or hand, the first that holds.  Files
    of language text are hand unless they are lock files.  Null or empty code
    counts as no text; copies of a chunk row count once; overlapping windows
    are counted as often as they occur, which hardly moves a share.
    """
    total = (
        chunk_layout(chunks)
        .distinct()
        .groupBy("blob_hash")
        .agg(
            F.min("language").alias("language"),
            *[(F.max if s == "longest" else F.sum)(s).alias(s) for s in _STATS],
            F.max("tool_note").alias("tool_note"),
            F.max("copy_note").alias("copy_note"),
        )
    )
    share = lambda s, of: F.col(s) / F.greatest(F.col(of), F.lit(1))
    code = F.coalesce(F.col("language"), F.lit("")) != "text"
    limit = lambda table, other, n: _by_language({k: v[n] for k, v in table.items()}, other[n])
    minified = (share("long_bytes", "bytes") > limit(MINIFIED, MINIFIED_ELSE, 0)) & (share("spaces", "bytes") < limit(MINIFIED, MINIFIED_ELSE, 1))
    wrapped = (
        (share("bytes", "lines") >= limit(WRAPPED, WRAPPED_ELSE, 0))
        & (F.col("longest") >= limit(WRAPPED, WRAPPED_ELSE, 1))
        & (share("spaces", "bytes") < limit(WRAPPED, WRAPPED_ELSE, 2))
        & (share("alnum", "bytes") >= limit(WRAPPED, WRAPPED_ELSE, 3))
        & (F.col("lines") >= 3)
    )
    numbers = share("number_bytes", "bytes")
    table = (numbers > _by_language(NUMBER_SHARE, NUMBER_SHARE_ELSE)) & (
        (numbers > NUMBER_SHARE_ELSE) | (share("repeats", "lines") > TABLE_REPEAT)
    )
    encoded = share("run_bytes", "bytes") > ENCODED_SHARE
    rote = (share("repeats", "lines") > _by_language(REPEAT_SHARE, REPEAT_SHARE_ELSE)) & (F.col("lines") >= REPEAT_LINES)
    lock = F.coalesce(F.col("lock_name"), F.lit(False)) | (share("locks", "lines") > LOCK_SHARE)
    return total.join(places(files), "blob_hash").withColumn(
        "origin",
        F.when(~code, F.when(lock, "tool").otherwise("hand"))
        .when(F.col("tool_note"), "tool")
        .when(F.col("copy_note") | F.coalesce(F.col("vendor_place"), F.lit(False)), "copy")
        .when(encoded | table, "data")
        .when(minified | wrapped, "minified")
        .when(rote | lock, "tool")
        .otherwise("hand"),
    )


def not_hand_written(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(blob_hash) of the blobs that nobody wrote by hand here."""
    return file_origin(chunks, files).where("origin <> 'hand'").select("blob_hash")
