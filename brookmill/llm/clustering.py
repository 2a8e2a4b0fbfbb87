"""Operator 12: k-means on integer vectors with zone maps along a Hilbert curve.

Vectors are scaled to integers, ordered by their place on a Hilbert curve through the axes
of greatest variance, and stored as blocks of ``BLOCK`` neighbours with the least and
greatest value of each component.  In a round every task reads blocks, finds by the boxes
which centroids can be nearest to any point of the box, and compares the block's vectors
with these alone, exactly.  A centroid is out if its least distance to the box exceeds
another's greatest, or if the box lies wholly on the other side of the plane half-way to
the centroid nearest to its middle.  Both tests are in integers, and ties stay in.

The vectors are shuffled once.  A round returns k x (dimensions + 1) sums a task, which are
added up before k x dimensions numbers reach the driver; k centroids go back with the tasks.
Equal vectors are spread over the ranges by a hash of their id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism, text_slices, written

BLOCK = 128
#: Bytes of blocks that one step works on.
STEP_BYTES = 4 << 20
#: Axes of the curve and bits of each: a place on it fits a long.
AXES, BITS = 8, 7
#: Integers of more than so many bits would overflow a squared distance of 64 components.
LIMIT = 1 << 27
#: Below this, distances are exact in double precision.
EXACT = 1 << 19

BLOCKS = "ids array<bigint>, vectors binary, low binary, high binary"
BLOCKS_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def hilbert_places(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n x axes, integers below 2**bits).

    The axes are turned into the curve's transposed index by exclusive ors from the highest
    bit down, a Gray code undoes the steps, and the bits of all axes are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for i in range(n):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inside, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to a point of each box (rows)."""
    c = centroids[None]
    low, high = low[:, None], high[:, None]
    outside = np.maximum(np.maximum(low - c, c - high), 0)
    least = (outside * outside).sum(2)
    far = np.maximum(np.abs(c - low), np.abs(c - high))
    possible = least <= (far * far).sum(2).min(1)[:, None]
    middle = (low + high) // 2 - c
    nearest = centroids[(middle * middle).sum(2).argmin(1)][:, None]
    # over the box, the greatest of |x - nearest|^2 - |x - c|^2
    slope = 2 * (c - nearest)
    greatest = np.where(slope > 0, slope * high, slope * low).sum(2) + (nearest * nearest - c * c).sum(2)
    return possible & (greatest >= 0)


def nearest_of(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the first of equals; exact."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if most <= EXACT:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(best)), best].astype(np.int64)


def _matrix(column: pa.Array, dims: int, dtype: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims).astype(np.int64)


def assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, cluster, distance) of the batch's blocks, block groups of equal candidates together."""
    dims = centroids.shape[1]
    which = candidates(_matrix(batch.column(2), dims), _matrix(batch.column(3), dims), centroids)
    sets, group = np.unique(which, axis=0, return_inverse=True)
    for g, chosen in enumerate(sets):
        blocks = batch.take(pa.array(np.flatnonzero(group.ravel() == g)))
        numbers = np.flatnonzero(chosen)
        vectors = _matrix(blocks.column(1), dims)
        best, distance = nearest_of(vectors, centroids[numbers])
        yield blocks.column(0).flatten(), vectors, numbers[best], distance


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component of vectors with exactly ``dims`` finite components.

    Others go.  A component that gives more than 2**27 is an error, as squared distances
    would not fit a long.
    """
    e = F.col(vector_column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    x: Column = F.transform(e, lambda c: F.floor(c.cast("double") * scale))
    checked = F.when(F.forall(x, lambda c: F.abs(c) <= LIMIT), x).otherwise(F.raise_error(F.lit(f"a component beyond {LIMIT}")))
    kept = vectors.where(F.coalesce((F.size(e) == dims) & finite, F.lit(False)))
    return kept.select(F.col(id_column).cast("bigint").alias("id"), checked.cast("array<int>").alias("v"))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def main_axes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, spread) of greatest variance, from one row of moments a task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims * dims + dims + 1)
        for batch in batches:
            x = _vectors(batch.column(0), dims).astype(np.float64)
            total += np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    rows = vectors.select("v").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # dims * dims + dims + 1
    total = np.zeros(dims * dims + dims + 1)
    for r in rows:
        total[r["at"]] = r["value"]
    n = max(total[-1], 1.0)
    mean = total[dims * dims : -1] / n
    spread, axes = np.linalg.eigh(total[: dims * dims].reshape(dims, dims) / n - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :AXES], np.sqrt(np.maximum(spread[::-1][:AXES], 1e-9))


def hilbert_blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Blocks of neighbours on the curve with their boxes, written to the shared folder."""
    mean, axes, spread = main_axes(vectors, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = (_vectors(batch.column(1), dims) - mean) @ axes / spread  # most lie within three
            cells = np.clip((along + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_places(cells, BITS))], names=["id", "v", "place"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), dims).astype("<i4")
            cuts = [(a, min(a + BLOCK, len(x))) for a in range(0, len(x), BLOCK)]
            parts = [x[a:b] for a, b in cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).slice(a, b - a) for a, b in cuts], pa.list_(pa.int64())), pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.array([p.min(0).tobytes() for p in parts], pa.binary()), pa.array([p.max(0).tobytes() for p in parts], pa.binary()),
                ],
                schema=BLOCKS_ARROW,
            )

    placed = vectors.select("id", "v").mapInArrow(place, "id long, v array<int>, place long")
    ordered = placed.repartitionByRange(parallelism(vectors.sparkSession), "place", F.xxhash64("id", "v")).sortWithinPartitions("place", "id")
    return written(ordered.select("id", "v").mapInArrow(block, BLOCKS), "blocks")


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sums by (cluster, component); component -1 is the count, -2 the distances."""
    k, dims = centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 2), np.int64)
        for batch in text_slices(batches, "vectors", STEP_BYTES):
            for _, vectors, cluster, distance in assigned(batch, centroids):
                order = np.argsort(cluster, kind="stable")
                held, first = np.unique(cluster[order], return_index=True)
                total[held] += np.add.reduceat(np.column_stack([vectors, np.ones(len(vectors), np.int64), distance])[order], first)
        cluster, at = np.divmod(np.arange(total.size), dims + 2)
        component = np.where(at < dims, at, dims - 1 - at)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(component), pa.array(total.ravel())], names=["cluster", "component", "value"])

    parts = blocks.mapInArrow(part, "cluster long, component long, value long")
    rows = parts.groupBy("cluster", "component").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # k * (dims + 2)
    return {(r["cluster"], r["component"]): int(r["value"]) for r in rows}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the smallest SHA-256, equal ones by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.orderBy(digest, "v").limit(k).select("v").collect()], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Clusters the vectors that have ``dims`` finite components by ``rounds`` of k-means.

    One row per vector: vec_id, cluster, distance (squared, between integers), cluster_inertia,
    inertia, centroid_sha256.  Vectors that are null or hold nulls, NaN or infinities, or have
    another length are left out; a null vec_id and repeated ids are rows like any other; other
    columns are ignored.  Fewer than k vectors give as many clusters; none give no rows.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, dims, scale)
    centroids = first_centroids(whole, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = hilbert_blocks(whole, dims)
    for _ in range(rounds):
        sums = _sums(blocks, centroids)
        moved = np.array([[sums[c, d] // sums[c, -1] for d in range(dims)] if sums[c, -1] else centroids[c] for c in range(len(centroids))], np.int64)
        if (moved == centroids).all():  # further rounds would change nothing
            break
        centroids = moved
    last = _sums(blocks, centroids)
    inertia = np.array([last[c, -2] for c in range(len(centroids))], np.int64)
    total = int(inertia.sum())
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "vectors", STEP_BYTES):
            for ids, _, cluster, distance in assigned(batch, centroids):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(inertia[cluster]), pa.array(np.full(len(cluster), total)), pa.array(digests[cluster])],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(label, schema)
