"""Cutting files into chunks: line windows, and structure where it can be seen; and whole files from chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

WINDOW, OVERLAP, MOST_BYTES = 120, 20, 16384
MOST_INKED = 1600


@F.pandas_udf(ArrayType(IntegerType()))
def _running_sums(values: pd.Series) -> pd.Series:
    return values.map(lambda v: np.concatenate(([0], np.cumsum(v))).astype(np.int32))


def line_windows(
    files: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(key, byte_start, byte_end, line_start, line_end): overlapping windows of lines.

    Windows start every ``window - overlap`` lines until one reaches the end;
    windows longer than ``most_bytes`` are sliced.  Null and empty texts have
    none.  Lines count from 1, bytes are those of UTF-8.
    """
    step = window - overlap
    sizes = F.transform(F.split(F.col(text), "\n"), lambda x: F.octet_length(x) + 1)
    lines = files.where(F.col(text).isNotNull() & (F.octet_length(text) > 0)).select(
        key, F.octet_length(text).alias("size"), F.explode(F.array(sizes)).alias("raw"), F.col(text).endswith("\n").alias("closed")
    )
    lines = lines.select(key, "size", F.explode(F.array(F.when(F.col("closed"), F.slice("raw", 1, F.size("raw") - 1)).otherwise(F.col("raw")))).alias("n"))
    # running sums, [0, n1, n1 + n2, ...], in time proportional to the lines
    summed = lines.select(key, "size", F.size("n").alias("k"), F.explode(F.array(_running_sums("n"))).alias("cum"))
    last = F.greatest(F.lit(0), F.ceil((F.col("k") - window) / step)) * step
    starts = summed.select(key, "size", "k", "cum", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("s"))
    spans = starts.select(
        key,
        (F.col("s") + 1).cast("int").alias("line_start"),
        F.least(F.col("s") + window, F.col("k")).cast("int").alias("line_end"),
        F.element_at("cum", (F.col("s") + 1).cast("int")).alias("b"),
        F.least(F.element_at("cum", (F.least(F.col("s") + window, F.col("k")) + 1).cast("int")), F.col("size")).alias("e"),
    )
    cut = spans.select("*", F.explode(F.sequence(F.col("b"), F.col("e") - 1, F.lit(most_bytes))).alias("byte_start"))
    return cut.select(key, "byte_start", F.least(F.col("byte_start") + most_bytes, F.col("e")).alias("byte_end"), "line_start", "line_end")


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """(blob_hash, at, language, code): the chunks of a blob in one task, sorted by place; rows without one are dropped."""
    return (
        chunks.where("code is not null and blob_hash is not null and byte_start is not null")
        .select(F.lower("blob_hash").alias("blob_hash"), F.col("byte_start").cast("long").alias("at"), "language", "code")
        .repartition("blob_hash")
        .sortWithinPartitions("blob_hash", "at")
    )


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, int, bytes]]:
    """(blob_hash, language, start, bytes) of every unbroken run of a blob, from batches of ``placed_chunks``.

    Chunks are joined as they stream by, overlaps once; nothing is held but the
    run being joined.  The first run of a blob starts at 0, and is empty if the
    blob's first chunk does not; a gap begins another.
    """
    key, lang, start, data = None, None, 0, bytearray()
    for batch in batches:
        code = batch.column("code").cast(pa.binary())
        for i, (blob, at, language) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("blob_hash", "at", "language")))):
            if blob != key or at > start + len(data):
                if key is not None:
                    yield key, lang, start, bytes(data)
                if blob != key:
                    key, lang, start, data = blob, language, 0, bytearray()
                    if at > 0:
                        yield key, lang, 0, b""
                        start = at
                else:
                    start, data = at, bytearray()
            piece = code[i].as_py()
            if at + len(piece) > start + len(data):
                data += piece[start + len(data) - at :]
    if key is not None:
        yield key, lang, start, bytes(data)


def whole_files(chunks: DataFrame) -> DataFrame:
    """(blob_hash, language, byte_start, text): every blob put together from its chunks.

    ``byte_start`` is 0, and the text the whole blob; only where chunks leave a
    gap, what follows it is a row of its own.
    """
    names = ["blob_hash", "language", "byte_start", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lang, start, data in joined(batches):
            if data:
                row = ([key], [lang], [start], [data.decode("utf-8", "replace")])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=names)

    return placed_chunks(chunks).mapInArrow(run, "blob_hash string, language string, byte_start long, text string")


def _extents(data: bytes, language: str) -> list[tuple[int, int]]:
    """Top-level extents that cover the bytes: statements of Python, bracket-balanced runs of other languages
    and of Python that does not parse."""
    starts = _statement_starts(data) if language == "python" else None
    starts = sorted({0, *(_margin_starts(data, language == "python") if starts is None else starts)})
    return [(a, b) for a, b in zip(starts, [*starts[1:], len(data)]) if b > a]


def _statement_starts(data: bytes) -> list[int] | None:
    """Where the top-level statements of Python begin, with their decorators; None if it does not parse."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, starts = [0], []
    for line in data.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    for node in tree.body:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        starts.append(lines[first - 1])
    return starts


def _margin_starts(data: bytes, python: bool = False) -> list[int]:
    """Where lines begin at the margin outside all brackets; a definition of Python there closes what an error left open."""
    starts, depth, at = [], 0, 0
    for line in data.splitlines(keepends=True):
        if python and line.startswith((b"def ", b"class ", b"async def ", b"@")):
            depth = 0
        if depth == 0 and line.strip() and not line[:1].isspace() and line[:1] not in b")}]":
            starts.append(at)
        depth = max(0, depth + line.count(b"{") + line.count(b"(") + line.count(b"[") - line.count(b"}") - line.count(b")") - line.count(b"]"))
        at += len(line)
    return starts


MOST_DEPTH = 50
#: Share of bytes in extents with errors beyond which a file has no structure worth keeping.
MOST_TAINTED = 0.5
#: How a comment begins, by language.
MARKERS = {"python": "#", "text": "#", "javascript": "//", "typescript": "//", "tsx": "//", "go": "//", "proto": "//"}
FIRST_LINE = 120


def _inked(data: bytes, a: int, b: int) -> int:
    return (b - a) - sum(data.count(c, a, b) for c in (b" ", b"\n", b"\t", b"\r"))


def _at_lines(data: bytes, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
    """Cuts at line ends while a piece holds at most ``most`` inked bytes; a longer line at characters."""
    while _inked(data, a, b) > most:
        cut = at = a
        while at < b:
            nxt = data.find(b"\n", at, b) + 1 or b
            if _inked(data, a, nxt) > most:
                break
            cut = at = nxt
        if cut == a:  # one line is too long
            cut = min(b, a + most)
            while cut < b and data[cut] & 0xC0 == 0x80:
                cut += 1
        yield a, cut
        a = cut
    if a < b:
        yield a, b


def _scopes(data: bytes, language: str) -> list[tuple[int, int, str, int]]:
    """(start, end, name, depth) of the definitions of a file, from the beginning of their line."""
    from tessera.operators.facts import FAMILIES, read_facts

    if language not in FAMILIES:
        return []
    out: list[tuple[int, int, str, int]] = []
    open_: list[int] = []
    for name, kind, a, b, *_ in read_facts(data, language)[0]:
        if kind == "const":
            continue
        while open_ and out[open_[-1]][1] <= a:
            open_.pop()
        open_.append(len(out))
        out.append((data.rfind(b"\n", 0, a) + 1, b, name, len(open_) - 1))
    return out


def _windows(data: bytes, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
    """Windows of lines without overlap, each within the limit."""
    at, n = a, 0
    for line in data[a:b].splitlines(keepends=True):
        n, at = n + 1, at + len(line)
        if n == WINDOW:
            yield from _at_lines(data, a, at, most)
            a, n = at, 0
    if a < b:
        yield from _at_lines(data, a, b, most)


def _tainted(data: bytes, extents: list[tuple[int, int]]) -> set[tuple[int, int]] | None:
    """Of a Python file that does not parse the extents that don't either; None if it has no structure worth keeping."""
    import ast
    import warnings

    bad, clean = set(), 0
    for a, b in extents:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(data[a:b])
            clean += any(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) for x in tree.body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            bad.add((a, b))
    return None if not clean or sum(b - a for a, b in bad) > MOST_TAINTED * len(data) else bad


def pieces(data: bytes, language: str, most: int = MOST_INKED, scopes: list | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, tainted): pieces that partition the bytes, each of at most ``most`` inked bytes.

    An extent that is too large is split at the definitions in it, level by
    level, at last at lines; then adjacent pieces are merged while they fit.  Of
    Python that does not parse, the extents that do are treated as usual; the others
    come as windows of lines that are marked and never merged.  If they
    make up most of the file, or no definition is whole, all of it comes as windows.
    Languages without structure come as windows, too.
    """
    if not data:
        return []
    if language not in MARKERS or language == "text":
        return [(a, b, False) for a, b in _windows(data, 0, len(data), most)]
    extents, bad = _extents(data, language), set()
    if language == "python" and _statement_starts(data) is None:
        bad = _tainted(data, extents)
        if bad is None:
            return [(a, b, True) for a, b in _windows(data, 0, len(data), most)]
    scopes = _scopes(data, language) if scopes is None else scopes
    starts: dict[int, list[int]] = {}
    for a, _, _, depth in scopes:
        starts.setdefault(depth, []).append(a)

    def split(a: int, b: int, depth: int) -> Iterator[tuple[int, int]]:
        if _inked(data, a, b) <= most:
            yield a, b
        elif depth > min(MOST_DEPTH, max(starts, default=-1)):
            yield from _at_lines(data, a, b, most)
        else:
            edges = [a, *[c for c in starts.get(depth, ()) if a < c < b], b]
            for x, y in zip(edges, edges[1:]):
                yield from split(x, y, depth + 1)

    out: list[tuple[int, int, bool]] = []
    for a, b in extents:
        if (a, b) in bad:
            out += [(x, y, True) for x, y in _windows(data, a, b, most)]
            continue
        for x, y in split(a, b, 0):
            if out and not out[-1][2] and _inked(data, out[-1][0], y) <= most:
                out[-1] = (out[-1][0], y, False)
            else:
                out.append((x, y, False))
    return out


def structural_pieces(data: bytes, language: str, most: int = MOST_INKED) -> list[tuple[int, int]]:
    """The (start, end) of :func:`pieces`."""
    return [(a, b) for a, b, _ in pieces(data, language, most)]


def breadcrumbs(data: bytes, language: str, path: str, cut: list[tuple[int, int, bool]], scopes: list | None = None) -> list[str]:
    """One line for each piece: comment marker, path, the definitions around its first inked byte, and its first line.

    Python definitions with a docstring show its first line; a tainted piece says so.
    """
    marker, out = MARKERS.get(language, "#"), []
    scopes = _scopes(data, language) if scopes is None else scopes
    for a, b, bad in cut:
        body = data[a:b].lstrip()
        at = b - len(body)
        around = [n for x, y, n, _ in scopes if x <= at < y]
        first = body.split(b"\n", 1)[0].decode("utf-8", "replace").strip()[:FIRST_LINE]
        parts = [f"{marker} {path}", *([" > ".join(around)] if around else []), first]
        if language == "python" and (m := re.match(rb"[^\n]*:[ \t]*\n[ \t]*[rRuU]?(?:\"{3}|'{3})[ \t]*([^\n]*)", body)):
            parts.append(m[1].decode("utf-8", "replace").strip().rstrip("\"'").strip()[:FIRST_LINE])
        out.append(" :: ".join([*[p for p in parts if p], *(["does not parse"] if bad else [])]))
    return out


def structural_chunks(
    files: DataFrame, key: str, text: str, language: str, most: int = MOST_INKED, start: str | None = None, path: str | None = None
) -> DataFrame:
    """(key, byte_start, byte_end, code, breadcrumb, tainted): chunks that partition every file, as :func:`pieces` cuts it.

    ``start`` is the place of a text within its file, 0 if there is no such
    column; ``path`` goes into the breadcrumb, else the key.  Null and empty texts
    have no chunk.
    """
    schema = pa.schema([("key", pa.string()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("code", pa.string()), ("breadcrumb", pa.string()), ("tainted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, lang, at, where in zip(*(batch.column(n).to_pylist() for n in ("key", "text", "language", "start", "path"))):
                data, lang = t.encode(), lang or "text"
                scopes = _scopes(data, lang)
                cut = pieces(data, lang, most, scopes)
                rows += [(k, at + a, at + b, data[a:b].decode(), crumb, bad) for (a, b, bad), crumb in zip(cut, breadcrumbs(data, lang, where or "", cut, scopes))]
            cols = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    wanted = files.where(F.col(text).isNotNull() & (F.octet_length(text) > 0)).select(
        F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(language).alias("language"), (F.col(start) if start else F.lit(0)).cast("long").alias("start"),
        F.col(path or key).cast("string").alias("path"),
    )
    found = wanted.mapInArrow(run, "key string, byte_start int, byte_end int, code string, breadcrumb string, tainted boolean")
    return found.withColumnRenamed("key", key)
