"""Operator 1: near-duplicate vectors by a subspace pigeonhole join.

For unit vectors, cosine >= t means a squared distance of at most 2 - 2t.  The vectors are
turned by one fixed random rotation, which spreads their energy evenly, and split into
blocks.  Each block has a part of the squared-distance budget in proportion to its
dimensions, so a linked pair keeps the budget of at least one block: the blocks are
range-joined each on its own, over a grid on the block's first dimensions, and the union of
what they find is compared exactly in double precision.  A pair that several blocks find is
counted by the first of them only.

Equal vectors are joined once as one class.  A crowded cell is split into chunks; a task
holds one chunk and streams the rows that probe it.  Rows carry a vector's own components;
units and turned vectors are made from them, a batch at a time, where they are needed, and
the cosine that decides is taken from the units, not from the turned vectors.  Tasks return
link counts and edges that join up what is linked, at most one for each row, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written
from .components import connected_components

BLOCK_DIMS = 16
GRID_DIMS = 2
#: Rows of a cell that a task holds at a time, and rows it streams against them.
CHUNK, SLICE = 8192, 512
ROTATION_SEED = 20_240_101
SLACK = 1e-9
#: What single precision may add to a block's squared distance.
ROUNDING = 1e-5

_VECTOR_SCHEMA = "vec_id long, dims int, key binary, vector binary"


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one in double precision, and which of them have a direction."""
    x = x.astype(float)
    peak = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(peak) & (peak > 0)
    x = np.where(good[:, None], x, 0) / np.where(good, peak, 1)[:, None]
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-300)[:, None], good


def _rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Components that were packed as bytes, in single or double precision."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), "<f4" if packed and len(packed[0]) == 4 * dims else "<f8").reshape(len(packed), dims)


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_borders(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def _vectors(table: DataFrame) -> DataFrame:
    """Vectors as bytes, with a digest of the unit as the class key; null where a row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = column.flatten()
            kind = "<f4" if flat.type == pa.float32() else "<f8"
            flat = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys, raw = [None] * len(sizes), [None] * len(sizes)
            for dims in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero((sizes == dims) & named)
                x = flat[starts[rows][:, None] + np.arange(dims)]
                unit, good = units(x)
                for i, u, v in zip(rows[good].tolist(), unit[good], x[good].astype(kind)):
                    keys[i], raw[i] = md5(u.tobytes()).digest(), v.tobytes()
            valid = pa.array([k is not None for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(valid, pa.array(sizes.astype(np.int32)), None), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "dims", "key", "vector"])

    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, _VECTOR_SCHEMA)


_CELL_SCHEMA = "block int, cell long, probe boolean, home boolean, rep long, n long, dims int, vector binary"


def _cells(classes: DataFrame, threshold: float) -> DataFrame:
    """Each class at home in one cell of every block, and as a probe in that cell and half its neighbours."""
    budget = 2 - 2 * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                m = part.num_rows
                turned = units(_rows_of(part.column(3), dims))[0] @ rotation(dims).T
                for block, (a, b) in enumerate(block_borders(dims)):
                    width = np.sqrt(budget * (b - a) / dims + 2 * SLACK) * (1 + 1e-6)
                    at = np.floor(turned[:, a : min(b, a + GRID_DIMS)] / width).astype(np.int64)
                    for step in product((-1, 0, 1), repeat=at.shape[1]):
                        if next((x for x in step if x), 1) > 0:
                            cell = np.zeros(m, np.int64)
                            for place, move in zip(at.T, step):
                                cell = cell << 20 | (place + move + (1 << 19))
                            home = not any(step)
                            for probe in (True, False)[: 1 + home]:
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(m, block, np.int32)), pa.array(cell), pa.array([probe] * m), pa.array([home] * m), part.column(0), part.column(1), part.column(2), part.column(3)],
                                    names=["block", "cell", "probe", "home", "rep", "n", "dims", "vector"],
                                )

    return classes.select("rep", "n", "dims", "vector").mapInArrow(run, _CELL_SCHEMA)


class _Chunk:
    """The rows of one chunk of a cell, with the links found so far and edges that join them up."""

    def __init__(self, block: int, dims: int, threshold: float):
        self.block, self.dims, self.threshold = block, dims, threshold
        self.borders = block_borders(dims)
        self.budgets = (2 - 2 * threshold) * np.array([b - a for a, b in self.borders]) / dims + SLACK
        self.parts: list[tuple] = []
        self.ready = False
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # class, vectors linked with it
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, reps: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.append((reps, sizes, vectors))

    def _prepare(self) -> None:
        self.reps, self.sizes, vectors = (np.concatenate(x) for x in zip(*self.parts))
        self.unit = units(vectors)[0]
        self.turned = self.unit @ rotation(self.dims).T
        self.mine = self._block(self.turned)
        self.counts = np.zeros(len(self.reps), np.int64)
        self.root = np.arange(len(self.reps))
        self.parts.clear()
        self.ready = True

    def _block(self, turned: np.ndarray, budget: float = 0.0, probe: bool = False) -> np.ndarray:
        """Block coordinates in single precision with two more, so that the product of a row and
        a probe is (budget - squared distance) / 2."""
        a, b = self.borders[self.block]
        x = turned[:, a:b]
        half, one = (budget - np.einsum("ij,ij->i", x, x)) / 2, np.ones(len(x))
        return np.column_stack([x, one, half] if probe else [x, half, one]).astype(np.float32)

    def meet(self, reps: np.ndarray, sizes: np.ndarray, home: np.ndarray, vectors: np.ndarray) -> None:
        if not self.ready:
            self._prepare()
        unit = units(vectors)[0]
        turned = unit @ rotation(self.dims).T
        i, j = np.nonzero(self.mine @ self._block(turned, self.budgets[self.block] + ROUNDING, probe=True).T >= 0)
        keep = ~home[j] | (reps[j] < self.reps[i])
        i, j = i[keep], j[keep]
        linked = np.zeros(len(i), bool)
        for part in range(0, len(i), 4096):  # the exact check, in bounded parts
            x, y = i[part : part + 4096], j[part : part + 4096]
            difference = (self.turned[x] - turned[y]) ** 2
            within = np.add.reduceat(difference, [start for start, _ in self.borders], axis=1) <= self.budgets
            first = within[:, self.block] & ~within[:, : self.block].any(axis=1)
            linked[part : part + 4096] = first & (np.einsum("ij,ij->i", self.unit[x], unit[y]) >= self.threshold)
        i, j = i[linked], j[linked]
        if not len(i):
            return
        self.counts += np.bincount(i, sizes[j], len(self.reps)).astype(np.int64)
        theirs = np.bincount(j, self.sizes[i], len(reps)).astype(np.int64)
        self.found.append((reps[theirs > 0], theirs[theirs > 0]))
        self._join(i, j, reps)

    def _join(self, i: np.ndarray, j: np.ndarray, reps: np.ndarray) -> None:
        """An edge from each probe to the first row it is linked with, and from there to others not yet joined."""
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        new = np.concatenate([[True], j[1:] != j[:-1]])
        first = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        self.edges.append((self.reps[i[new]], reps[j[new]]))
        pairs = np.unique(np.stack([self.root[first], self.root[i]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            up = np.arange(len(self.reps))
            joined = []
            for p, q in pairs.tolist():
                while up[p] != p:
                    p = up[p]
                while up[q] != q:
                    q = up[q]
                if p != q:
                    up[max(p, q)] = min(p, q)
                    joined.append((p, q))
            while (up[up] != up).any():
                up = up[up]
            self.root = up[self.root]
            joined = np.array(joined, np.int64).reshape(-1, 2)
            self.edges.append((self.reps[joined[:, 0]], self.reps[joined[:, 1]]))

    def result(self) -> pa.RecordBatch | None:
        if not self.edges:
            return None
        own = np.flatnonzero(self.counts)
        a, b = (np.concatenate(x) for x in zip(*self.edges))
        reps, n = (np.concatenate(x) for x in zip((self.reps[own], self.counts[own]), *self.found))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, reps])), pa.concat_arrays([pa.array(b), pa.nulls(len(reps), pa.int64())]), pa.array(np.concatenate([np.zeros(len(a), np.int64), n]))], names=["a", "b", "n"])


def _join_cells(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, 0): classes of one component; (a, null, n): n vectors linked with class a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, cell, dims, number, probe, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            reps, sizes = batch.column(6).to_numpy(), batch.column(7).to_numpy()
            change = np.zeros(batch.num_rows, bool)
            for x in (block, cell, dims, number, probe):
                change[1:] |= x[1:] != x[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                here = (block[a], cell[a], dims[a], number[a])
                if here != key:
                    if chunk is not None and (out := chunk.result()) is not None:
                        yield out
                    key, chunk = here, None
                if not probe[a]:  # a chunk's own rows come before those that probe it
                    chunk = chunk or _Chunk(int(block[a]), int(dims[a]), threshold)
                    chunk.add(reps[a:b], sizes[a:b], _rows_of(batch.column(8).slice(a, b - a), int(dims[a])))
                elif chunk is not None:
                    for begin in range(a, b, SLICE):
                        end = min(begin + SLICE, b)
                        chunk.meet(reps[begin:end], sizes[begin:end], home[begin:end], _rows_of(batch.column(8).slice(begin, end - begin), int(dims[a])))
        if chunk is not None and (out := chunk.result()) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long, n long")


def link_vectors(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding).

    Vectors link if their cosine in double precision is at least ``threshold``.  A vector
    that is null, empty, all zero, or holds a null or non-finite component, and a row whose
    id is null, link with nothing; vectors of different lengths do not link.  ``n_links``
    counts other vectors linked directly, copies included.  Rows that repeat an id and a
    vector count as copies.  Other columns are ignored; an empty table gives no rows.
    """
    vectors = written(_vectors(table), "vectors")
    valid = vectors.where("key is not null")
    classes = written(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("dims").alias("dims"), F.any_value("vector").alias("vector")), "classes")
    cells = _cells(classes, threshold)
    sizes = cells.where("not probe").groupBy("block", "dims", "cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    placed = cells.join(sizes, ["block", "dims", "cell"])  # a probe of a cell without rows goes
    own = placed.where("not probe").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    probing = placed.where("probe").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = own.unionByName(probing)
    dealt = rows.repartition(parallelism(table.sparkSession), "block", "dims", "cell", "chunk").sortWithinPartitions("block", "dims", "cell", "chunk", "probe", "rep")
    found = written(_join_cells(dealt.select("block", "cell", "dims", "chunk", "probe", "home", "rep", "n", "vector"), threshold), "links")
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    by_class = classes.select("key", "rep", "n").join(roots, "rep", "left").join(counts, "rep", "left")
    by_class = by_class.select("key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = vectors.select("vec_id", "key").join(by_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
