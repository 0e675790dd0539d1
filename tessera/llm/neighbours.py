"""Most similar vectors for every vector, by an inverted multi-index.

Unit vectors are cut into two halves, each half is quantised to one of K
centroids, and a cell is a pair of centroids.  Cells that lie close are packed
into blocks of a bounded number of entries; a crowded cell has several blocks.

Every vector is an entry and a query, so a query begins where it lies.  In its
own block it walks the cells by summed distance with a heap until it has seen
some entries and reranks those by the exact cosine.  The k-th similarity so found
is the floor for its whole block, which one product of matrices reranks for many
queries.  Of the cells of other blocks only those can hold a better entry that
come, less their radius in both halves, within the floor; only to their blocks
the query travels, once each.  The walk makes the bound tight and the bound makes
the result exact, whatever the size and skew.

A task holds the matrix of one block, while its queries stream past in Arrow
batches.  Vectors are shuffled to their block, once more with the queries that
travel, and not written anywhere between.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

K_NEAREST, LEAST_COSINE = 10, 0.75
#: Vectors per model on which centroids are fitted; every vector is indexed.
FIT_SAMPLE = 20_000
#: Bound on the centroids of a half: the table of cell sizes has at most its square, a million entries.
MOST_CENTROIDS = 1024
#: Entries a query's walk has to pass before it ends, and entries of a block.
WALK_ENTRIES, BLOCK_ENTRIES = 200, 16384
#: Similarities are rounded to 6 decimals and distances carry rounding errors; bounds are looser by this.
SLACK = 2e-6


@dataclass
class Quantiser:
    """Centroids of both halves; of each cell the number of entries, the radii and the blocks."""

    first: np.ndarray
    second: np.ndarray
    cells: np.ndarray | None = None
    held: tuple[np.ndarray, ...] | None = None
    block_of: np.ndarray | None = None
    parts_of: np.ndarray | None = None

    def count(self, cells: np.ndarray, radii: np.ndarray) -> None:
        """Takes the cell sizes and radii in both halves, and packs cells into blocks: rows in a chain of near
        centroids, in each row the columns in such a chain."""
        self.cells, self.parts_of = cells, np.maximum(1, -(-cells // BLOCK_ENTRIES))
        self.block_of = np.zeros(cells.shape, np.int64)
        n, room = -1, 0
        columns = _chain(self.second)
        for i in _chain(self.first):
            for j in columns[cells[i, columns] > 0]:
                size = int(cells[i, j])
                if size > room:
                    n, room = n + 1, BLOCK_ENTRIES
                self.block_of[i, j] = n
                room -= size
                if size > BLOCK_ENTRIES:
                    n, room = n + int(self.parts_of[i, j]) - 1, 0
        i, j = np.nonzero(cells)
        self.held = i, j, radii[0, i, j], radii[1, i, j], radii[0].max(1), self.block_of[i, j], self.parts_of[i, j]

    def part(self, i: int, j: int, name: str) -> int:
        """The block that holds an entry of a cell."""
        parts = int(self.parts_of[i, j])
        return int(self.block_of[i, j]) + (zlib.crc32(name.encode()) % parts if parts > 1 else 0)

    def within(self, d1: np.ndarray, d2: np.ndarray, limit: float) -> np.ndarray:
        """Places in ``held`` of the cells that may hold an entry at most ``limit`` (squared) from a query at these squared distances.

        By the triangle inequality an entry is in each half at least as far as
        its centroid is, less the radius of its cell.
        """
        i, j, r1, r2, widest, *_ = self.held
        s1, s2 = np.sqrt(np.maximum(d1, 0)), np.sqrt(np.maximum(d2, 0))
        at = np.flatnonzero((s1 - widest <= math.sqrt(limit))[i])
        return at[np.maximum(s1[i[at]] - r1[at], 0) ** 2 + np.maximum(s2[j[at]] - r2[at], 0) ** 2 <= limit]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The centroids of each vector, and its distances from them."""
        n = len(x)
        x = np.concatenate([x, np.zeros((-n % 64, x.shape[1]))])  # whole tiles, so that a row's distances do not depend on its batch
        a, b = (d[:n] for d in self.distances(x))
        c1, c2 = a.argmin(1), b.argmin(1)
        at = np.arange(n)
        return c1, c2, np.sqrt(np.maximum(a[at, c1], 0)), np.sqrt(np.maximum(b[at, c2], 0))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _squared(x[:, :h], self.first), _squared(x[:, h:], self.second)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def _chain(c: np.ndarray) -> np.ndarray:
    """An order in which each centroid is followed by the nearest one not yet placed."""
    left, at, out = np.ones(len(c), bool), 0, []
    for _ in range(len(c)):
        left[at] = False
        out.append(at)
        if left.any():
            at = int(np.where(left, _squared(c[at : at + 1], c)[0], np.inf).argmin())
    return np.array(out)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; empty centroids move to the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = _squared(x, c)
        near = d.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        full = n > 0
        c[full] = sums[full] / n[full, None]
        if not full.all():
            c[~full] = x[np.argsort(-d[np.arange(len(x)), near])[: (~full).sum()]]
    return c


def walk(d1: np.ndarray, d2: np.ndarray, cells: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by summed distance until ``enough`` entries are passed (multi-sequence traversal).

    Empty cells count as passed.  A pair enters the heap when the pairs before it in both orders are out.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1], d2[o2]
    heap, out, passed = [(s1[0] + s2[0], 0, 0)], [], 0
    reach = np.zeros(len(o1) + 1, np.int64)  # of each row, how many columns are out
    while heap and passed < enough:
        _, i, j = heapq.heappop(heap)
        reach[i] = j + 1
        n = cells[o1[i], o2[j]]
        if n:
            out.append((int(o1[i]), int(o2[j])))
            passed += int(n)
        if j + 1 < len(o2) and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < len(o1) and reach[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return out


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(model, chunk_id, vector) with a vector of length dim, finite and not all zero; copies of a row may remain.

    Of several vectors of one chunk and model the least is taken.  Only ids and
    hashes are shuffled to see whether there are such chunks.
    """
    good = vectors.where(
        F.col("chunk_id").isNotNull() & F.col("model").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == F.col("dim"))
    ).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = good.select("model", "chunk_id", "vector")
    prints = rows.select("model", "chunk_id", F.xxhash64("vector").alias("p")).groupBy("model", "chunk_id").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    several = cut_lineage(prints.where("a <> b").select("model", "chunk_id"))
    if several.isEmpty():
        return rows
    key = ["model", "chunk_id"]
    return rows.join(several, key, "left_anti").unionByName(rows.join(several, key, "left_semi").groupBy(*key).agg(F.min("vector").alias("vector")))


def _matrix(col: pa.Array) -> np.ndarray:
    width = len(col[0]) if len(col) else 0
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(usable: DataFrame, model: str, n: int) -> Quantiser:
    rows = (
        usable.where(F.col("model") == model)
        .orderBy(F.xxhash64("chunk_id"), "chunk_id")
        .limit(FIT_SAMPLE)
        .select("vector")
        .toArrow()
        .column("vector")
        .combine_chunks()
    )
    x = _matrix(rows).astype(np.float32)
    k = int(min(MOST_CENTROIDS, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n / 4)))))))
    h = x.shape[1] // 2 or 1
    return Quantiser(fit_centroids(x[:, :h], k), fit_centroids(x[:, h:], k, seed=11))


class Block:
    """The entries of one block, by cell, and the search among them."""

    def __init__(self, q: Quantiser, block: int, names: list[str], x: np.ndarray, c1: np.ndarray, c2: np.ndarray):
        order = sorted(range(len(names)), key=lambda i: (c1[i], c2[i], names[i]))
        order = [i for n, i in enumerate(order) if n == 0 or names[i] != names[order[n - 1]]]  # copies of a row lie together
        self.q, self.block = q, block
        self.names, self.x = np.array([names[i] for i in order], dtype=object), x[order]
        self.c1, self.c2 = c1[order], c2[order]
        by_name = np.argsort(self.names, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[by_name] = np.arange(len(order))
        # the grid of this block: its rows, its columns, and the run of entries of each cell
        self.rows, r = np.unique(self.c1, return_inverse=True)
        self.columns, c = np.unique(self.c2, return_inverse=True)
        self.grid = np.zeros((len(self.rows), len(self.columns)), np.int64)
        np.add.at(self.grid, (r, c), 1)
        self.start = np.zeros_like(self.grid)
        cell, firsts = np.unique(r * len(self.columns) + c, return_index=True)
        self.start.ravel()[cell] = firsts

    def entries(self, cells: list[tuple[int, int]]) -> np.ndarray:
        return np.concatenate([np.arange(self.start[a, b], self.start[a, b] + self.grid[a, b]) for a, b in cells]) if cells else np.zeros(0, np.int64)

    def best(self, name: str, at: np.ndarray, sims: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the k best of the entries ``at`` at or above the floor, ties by id; not the query itself."""
        near = np.flatnonzero(sims >= floor)
        near = near[self.names[at[near]] != name]
        near = near[np.lexsort((self.rank[at[near]], -sims[near]))[:k]]
        return at[near], sims[near]

    def walked(self, name: str, v: np.ndarray, d1: np.ndarray, d2: np.ndarray, enough: int, k: int, floor: float) -> float:
        """A lower bound of the k-th similarity, from the entries that the walk over this block's cells passes first."""
        at = self.entries(walk(d1[self.rows], d2[self.columns], self.grid, enough))
        _, sims = self.best(name, at, np.round(self.x[at] @ v, 6), k, floor)
        return float(sims[-1]) if len(sims) == k else floor

    def search(self, names: list[str], x: np.ndarray, floors: list[float], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``best`` gives of all entries, for each query; one product of matrices for all."""
        every = np.arange(len(self.names))
        for lo in range(0, len(names), 256):
            sims = np.round(x[lo : lo + 256] @ self.x.T, 6)
            for row, name, floor in zip(sims, names[lo : lo + 256], floors[lo : lo + 256]):
                yield self.best(name, every, row, k, floor)


def _others(q: Quantiser, held: np.ndarray, home: int) -> list[int]:
    """The blocks of the cells at these places, without one."""
    first, parts = q.held[5][held], q.held[6][held]
    out = set(first[parts == 1].tolist())
    for a, n in zip(first[parts > 1].tolist(), parts[parts > 1].tolist()):
        out.update(range(a, a + n))
    return sorted(out - {home})


def nearest(vectors: DataFrame, k: int = K_NEAREST, least: float = LEAST_COSINE, enough: int = WALK_ENTRIES) -> DataFrame:
    """(model, chunk_id, neighbour, similarity): up to k neighbours of every usable vector.

    Similarity is the cosine rounded to 6 decimals, at least ``least``; ties go
    to the smaller id.  The result is exact; ``enough`` only says how many entries
    are seen before the bound is taken.  Null, short, non-finite and all-zero vectors are not
    usable; of several vectors of one chunk and model the least is taken.
    Vectors of one model with different dims are indexed apart.  Empty tables
    give no row.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors).withColumn("model", F.concat_ws("\u0000", "model", F.size("vector").cast("string")))
    sizes = {r["model"]: r["n"] for r in usable.groupBy("model").agg(F.count("*").alias("n")).collect()}
    quantisers = {m: _fit(usable, m, n) for m, n in sizes.items()}
    fitted = spark.sparkContext.broadcast(quantisers)

    def cells_of(batch: pa.RecordBatch, qs: dict[str, Quantiser]):
        """(model, rows, c1, c2, e1, e2) of every model of a batch."""
        models = np.array(batch.column("model").to_pylist(), dtype=object)
        for m in sorted(set(models)):
            at = np.flatnonzero(models == m)
            yield m, at, *qs[m].assign(_matrix(batch.column("vector").take(pa.array(at))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, at, c1, c2, e1, e2 in cells_of(batch, fitted.value):
                cell, inv, n = np.unique(c1 * (MOST_CENTROIDS + 1) + c2, return_inverse=True, return_counts=True)
                r1, r2 = np.zeros(len(cell)), np.zeros(len(cell))
                np.maximum.at(r1, inv, e1)
                np.maximum.at(r2, inv, e2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(cell), pa.string()), *(pa.array(c, pa.int32()) for c in np.divmod(cell, MOST_CENTROIDS + 1)), pa.array(n, pa.int64()), pa.array(r1), pa.array(r2)],
                    names=["model", "c1", "c2", "n", "r1", "r2"],
                )

    cells = usable.mapInArrow(place, "model string, c1 int, c2 int, n long, r1 double, r2 double").groupBy("model", "c1", "c2")
    sizes_of = {m: np.zeros((len(q.first), len(q.second)), np.int64) for m, q in quantisers.items()}
    radii_of = {m: np.zeros((2, *n.shape)) for m, n in sizes_of.items()}
    for r in cells.agg(F.sum("n").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toLocalIterator():
        sizes_of[r["model"]][r["c1"], r["c2"]] = r["n"]
        radii_of[r["model"]][:, r["c1"], r["c2"]] = r["r1"], r["r2"]
    for m, q in quantisers.items():
        q.count(sizes_of[m], radii_of[m])
    index = spark.sparkContext.broadcast(quantisers)

    schema = pa.schema(
        [("model", pa.string()), ("block", pa.int32()), ("kind", pa.int8()), ("chunk_id", pa.string()), ("vector", pa.list_(pa.float32())), ("c1", pa.int32()), ("c2", pa.int32())]
        + [("floor", pa.float64()), ("found", pa.list_(pa.string())), ("sims", pa.list_(pa.float64()))]
    )
    ddl = "model string, block int, kind byte, chunk_id string, vector array<float>, c1 int, c2 int, floor double, found array<string>, sims array<double>"
    entry, query, result = 0, 1, 2

    def filled(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def same(value, n: int, kind) -> pa.Array:
        return pa.array([value] * n, kind)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, at, c1, c2, _, _ in cells_of(batch, index.value):
                ids = batch.column("chunk_id").take(pa.array(at))
                blocks = [index.value[m].part(i, j, name) for i, j, name in zip(c1.tolist(), c2.tolist(), ids.to_pylist())]
                yield filled(
                    len(at), model=same(m, len(at), pa.string()), block=pa.array(blocks, pa.int32()), kind=same(entry, len(at), pa.int8()), chunk_id=ids,
                    vector=batch.column("vector").take(pa.array(at)).cast(pa.list_(pa.float32())), c1=pa.array(c1, pa.int32()), c2=pa.array(c2, pa.int32()),
                )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """((model, block, kind), rows) as sorted rows stream by."""
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("model", "block", "kind"))))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                yield keys[a], batch.slice(a, b - a)

    def opened(key: tuple, parts: list[pa.RecordBatch]) -> Block:
        t = pa.Table.from_batches(parts)
        col = lambda n: t.column(n).to_numpy()
        return Block(index.value[key[0]], key[1], t.column("chunk_id").to_pylist(), _matrix(t.column("vector").combine_chunks()), col("c1"), col("c2"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = opened(key, parts)
            yield from parts  # entries, for queries that travel
            for lo in range(0, len(b.names), 1024):
                names, x = b.names[lo : lo + 1024], b.x[lo : lo + 1024]
                d1, d2 = b.q.distances(x)
                found, sims, sent, floors, to = [], [], [], [], []
                seen = [b.walked(name, x[n], d1[n], d2[n], enough, k, least) for n, name in enumerate(names)]
                for n, (at, s) in enumerate(b.search(names, x, seen, k)):
                    floor = float(s[-1]) if len(s) == k else least
                    found.append(b.names[at].tolist())
                    sims.append(s.tolist())
                    for block in _others(b.q, b.q.within(d1[n], d2[n], 2 - 2 * (floor - SLACK)), b.block):
                        sent.append(n)
                        to.append(block)
                        floors.append(floor)
                many = len(names)
                yield filled(
                    many, model=same(key[0], many, pa.string()), block=same(key[1], many, pa.int32()), kind=same(result, many, pa.int8()), chunk_id=pa.array(names, pa.string()),
                    found=pa.array(found, pa.list_(pa.string())), sims=pa.array(sims, pa.list_(pa.float64())),
                )
                for a in range(0, len(sent), 4096):
                    take = sent[a : a + 4096]
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1) * x.shape[1], pa.int32()), pa.array(x[take].astype(np.float32).ravel()))
                    yield filled(
                        len(take), model=same(key[0], len(take), pa.string()), block=pa.array(to[a : a + 4096], pa.int32()), kind=same(query, len(take), pa.int8()),
                        chunk_id=pa.array(names[take], pa.string()), vector=vec, floor=pa.array(floors[a : a + 4096]),
                    )

        key, parts = None, []
        for k_, rows in runs(batches):
            if k_ != key and parts:
                yield from search(key, parts)
                parts = []
            key = k_
            parts.append(rows)
        if parts:
            yield from search(key, parts)

    out = "model string, chunk_id string, neighbour string, similarity double"

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, b = None, [], None
        for (model, block, kind), rows in runs(batches):
            if (model, block) != held:
                held, parts, b = (model, block), [], None
            if kind == entry:
                parts.append(rows)
                continue
            names, found, sims = rows.column("chunk_id").to_pylist(), [], []
            if kind == result:
                found, sims = rows.column("found").to_pylist(), rows.column("sims").to_pylist()
            else:
                b = b or opened(held, parts)
                for at, s in b.search(names, _matrix(rows.column("vector")), rows.column("floor").to_pylist(), k):
                    found.append(b.names[at].tolist())
                    sims.append(s.tolist())
            many = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [same(model, sum(many), pa.string()), pa.array([x for x, n in zip(names, many) for _ in range(n)], pa.string()), pa.array([y for f in found for y in f], pa.string()), pa.array([y for f in sims for y in f], pa.float64())],
                names=["model", "chunk_id", "neighbour", "similarity"],
            )

    # the block is the partitioning key, so one task holds one matrix at a time
    homes = usable.select("model", "chunk_id", "vector").mapInArrow(store, ddl).repartition("model", "block").sortWithinPartitions("model", "block")
    travelled = homes.mapInArrow(at_home, ddl).repartition("model", "block").sortWithinPartitions("model", "block", "kind")
    best = Window.partitionBy("model", "chunk_id").orderBy(F.desc("similarity"), "neighbour")
    ranked = travelled.mapInArrow(abroad, out).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    return ranked.select(F.element_at(F.split("model", "\u0000"), 1).alias("model"), "chunk_id", "neighbour", "similarity")


def neighbour_pairs(vectors: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: either is a neighbour of the other under some model."""
    n = nearest(vectors)
    return n.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()
