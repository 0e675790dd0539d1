"""Splitting oversized items at natural boundaries.

A dynamic programme over boundary positions.  A state is the byte at which a
piece starts; a decision is the boundary at which it ends; the next state is the
restart that the overlap prescribes.  Boundaries are of three kinds: after a
blank line, after a line, between two characters.  Every decision of a state is
relaxed, and states are settled in the order of their labels, so each is settled
once, by a least path.  Two objectives, which differ in labels only:

``"first"``
    the label is the sequence of (kind, unused bytes) of the pieces so far, and
    sequences are compared from the front.  Of two labels that differ no later
    piece can change the order, and every state can be completed; so when a state
    is settled, the labels that are greater are dropped with their states and the
    common front of the rest need not be kept.
``"total"``
    the label is the sum over all pieces of the kind's weight and the squared
    share of unused bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, LEAST, OVERLAP = 4096, 1024, 400
WEIGHTS = (0.0, 1.0, 4.0)


def boundaries(data: bytes) -> tuple[list[int], list[int]]:
    """Positions after blank lines, and after any line."""
    buf = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(buf == 10) + 1
    if not len(ends):
        return [], []
    starts = np.concatenate(([0], ends[:-1]))
    inked = (buf != 32) & (buf != 9) & (buf != 13) & (buf != 10)
    upto = np.concatenate(([0], np.cumsum(inked)))
    return ends[upto[ends] == upto[starts]].tolist(), ends.tolist()


def _char_before(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _char_after(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def pieces(
    data: bytes, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, objective: str = "first", weights=WEIGHTS
) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one item; one piece if it is within the limit, none if empty."""
    size = len(data)
    if size <= limit:
        return [(0, size)] if size else []
    blank, lines = boundaries(data)

    def restart(end: int) -> int:
        k = bisect_left(lines, end - overlap)
        return lines[k] if k < len(lines) and lines[k] < end else _char_after(data, end - overlap)

    def decisions(s: int) -> Iterator[tuple[int, int]]:
        """(kind, end) of every boundary at which a piece from ``s`` may end; of character boundaries only the last."""
        lo, hi = s + least, s + limit
        soft = set(blank[bisect_right(blank, lo) : bisect_right(blank, hi)])
        for at in lines[bisect_right(lines, lo) : bisect_right(lines, hi)]:
            yield (0 if at in soft else 1), at
        yield 2, _char_before(data, hi)

    in_order = objective == "first"
    label: dict[int, tuple | float] = {0: () if in_order else 0.0}
    back: dict[int, tuple[int, int]] = {}  # how a state was reached: the one before it, and the end of that piece
    open_ = [(label[0], 0)]
    while True:
        so_far, s = heappop(open_)
        if so_far > label[s]:
            continue
        if s == size:  # the end has no piece of its own
            break
        if in_order:
            open_, label, so_far = [], {}, ()  # what was left is greater at some piece
        last = size - s <= limit
        for kind, end in [(0, size)] if last else decisions(s):
            to, unused = size if last else restart(end), limit - (end - s)
            price = (*so_far, (kind, unused)) if in_order else so_far + weights[kind] + (unused / limit) ** 2
            if to not in label or price < label[to]:
                label[to], back[to] = price, (s, end)
                heappush(open_, (price, to))
    out = []
    while s in back:
        s, end = back[s]
        out.append((s, end))
    return out[::-1]


def split_oversized(
    items: DataFrame,
    limit: int = LIMIT,
    least: int = LEAST,
    overlap: int = OVERLAP,
    objective: str = "first",
    id_col: str = "chunk_id",
    start_col: str = "byte_start",
    text_col: str = "code",
    label_col: str | None = None,
) -> DataFrame:
    """The pieces of every item whose text is longer than ``limit`` bytes.

    Columns (id, byte_start, byte_end), with ``label_col`` also (label, code).
    Positions count UTF-8 bytes from the item's own start.  Null or empty texts,
    texts within the limit and rows without a start give no row; copies of a row
    give their pieces once; other columns, whatever their names, are not read.
    """
    if not overlap < least < limit - 4:
        raise ValueError("overlap < least < limit - 4 is needed, else pieces might not advance")
    wanted = [F.col(id_col).cast("string").alias("id"), F.col(start_col).cast("long").alias("start"), F.col(text_col).alias("text")]
    if label_col:
        wanted.append(F.col(label_col).cast("string").alias("label"))
    big = items.where((F.octet_length(text_col) > limit) & F.col(start_col).isNotNull()).select(*wanted)
    fields = [(id_col, pa.string()), ("byte_start", pa.int64()), ("byte_end", pa.int64())]
    if label_col:
        fields += [(label_col, pa.string()), (text_col, pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            texts = batch.column("text").cast(pa.binary())
            labels = batch.column("label") if label_col else None
            for k, (id_, start) in enumerate(zip(batch.column("id").to_pylist(), batch.column("start").to_pylist())):
                data = texts[k].as_py()
                for a, b in pieces(data, limit, least, overlap, objective):
                    row = [id_, start + a, start + b]
                    if labels is not None:
                        row += [labels[k].as_py(), data[a:b].decode()]
                    for col, v in zip(cols, row):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(cols, fields)], schema=schema)

    ddl = f"{id_col} string, byte_start long, byte_end long" + (f", {label_col} string, {text_col} string" if label_col else "")
    return big.mapInArrow(run, ddl).distinct()
