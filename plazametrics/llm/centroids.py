"""Exact k-means over integer vectors, with centroids filtered by n-simplex projection.

Distances of a vector to P pivots are taken once and kept as apex coordinates: the pivots span a simplex of P - 1
dimensions, and a point with given distances to them is the apex over it, with the height over the simplex as last
coordinate. The pivots are centroids that span the others best; they are chosen anew, and distances taken again, in a
round where that at least halves the centroids' heights (after the first round: drawn vectors give way to means). Between two points, the Euclidean distance of their apexes is a lower bound, and the one with the sign of
one height turned an upper bound. A centroid whose lower bound exceeds the least upper bound cannot be the nearest;
the others are compared by exact integer arithmetic. Bounds are widened by more than their error, so they never decide
a result.

A vector is kept if it has exactly the wanted number of components, none null or not finite. Each component x becomes
floor(scale * x). A component beyond +-2**27 in that form would overflow a 64-bit distance: the job fails with
ValueError rather than return a wrong one. Repeated rows and repeated ids are vectors of their own; equal hashes of the
draw are ordered by components; a null id is the last in the draw. With fewer vectors than centroids there are as many
centroids as vectors, and without any no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

WIDEST = 1 << 27
#: Rows of a block: bounds and candidates of this many vectors are held at a time.
BLOCK = 8192
PIVOTS = 32


@dataclass
class Simplex:
    """Pivots (integers, one a row) and the triangle that turns distances to them into apex coordinates."""

    pivots: np.ndarray
    solve: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(points: np.ndarray, most: int = PIVOTS) -> "Simplex":
        """From ``most`` of the points at most: each is the farthest from the span of those before, if clearly out of it."""
        rest = points.astype(np.float64)
        least = 1e-3 * (1.0 + float(np.abs(rest).max(initial=0.0)))
        rows: list[int] = []
        while len(points) and len(rows) < most:
            lengths = (rest**2).sum(1)
            at = int(lengths.argmax())
            if not rows:
                rest = rest - rest[at]
            elif lengths[at] <= least**2:
                break
            else:
                axis = rest[at] / np.sqrt(lengths[at])
                rest = rest - np.outer(rest @ axis, axis)
            rows.append(at)
        pivots = points[rows]
        edges = (pivots[1:] - pivots[:1]).astype(np.float64)
        # Corners of the simplex in its own coordinates, from the factor of the edges' inner products.
        corners = np.linalg.cholesky(edges @ edges.T) if len(edges) else np.zeros((0, 0))
        return Simplex(pivots, np.linalg.inv(corners) if len(corners) else corners, (corners**2).sum(1))

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Apex coordinates from exact squared distances to the pivots, one row a point; the height comes last."""
        if not squared.shape[1]:
            return np.zeros((len(squared), 1))
        near = squared[:, :1].astype(np.float64)
        flat = (near + self.lengths - squared[:, 1:]) / 2 @ self.solve.T
        height = np.sqrt(np.maximum(near[:, 0] - (flat**2).sum(1), 0.0))
        return np.hstack([flat, height[:, None]])


def squared_distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to a few points."""
    out = np.empty((len(x), len(points)), np.int64)
    for j, p in enumerate(points):
        gap = x - p
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def heights(simplex: Simplex, centroids: np.ndarray) -> float:
    """Sum of the centroids' heights over the simplex: the less, the closer are both bounds."""
    return float(simplex.apexes(squared_distances(centroids, simplex.pivots))[:, -1].sum())


def candidates(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and centroids whose lower bound does not exceed the row's least upper bound, by row, then by centroid."""
    apexes = apexes.astype(np.float64)
    own, theirs = (apexes**2).sum(1), (centres**2).sum(1)
    lower = own[:, None] + theirs - 2.0 * (apexes @ centres.T)
    upper = lower + 4.0 * apexes[:, -1:] * centres[:, -1]
    # Apexes are kept in single precision, so that bounds are off by some millionths of what they add up.
    slack = 1e-5 * (own + theirs.max())[:, None] + 1.0
    return np.nonzero(lower <= upper.min(1)[:, None] + 2 * slack)


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centre_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number on ties) and its exact squared distance."""
    rows, picks = candidates(apexes, centre_apexes)
    exact = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), BLOCK):
        gap = x[rows[at : at + BLOCK]] - centroids[picks[at : at + BLOCK]]
        exact[at : at + BLOCK] = np.einsum("ij,ij->i", gap, gap)
    starts = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(exact, starts)
    hits = np.flatnonzero(exact == least[rows])
    first = hits[np.searchsorted(rows[hits], np.arange(len(x)))]
    return picks[first], least


def integer_vectors(df: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    """``df`` with kept vectors only and ``_ints``, their components as longs."""
    parts = F.col(vector)
    fine = (F.size(parts) == size) & F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    ints = F.transform(parts, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return df.where(parts.isNotNull() & fine).withColumn("_ints", ints)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def drawn(vectors: DataFrame, row_id: str, k: int, draw: str) -> np.ndarray:
    """The k vectors whose ``draw:id`` has the smallest sha256, in that order."""
    name = F.sha2(F.concat(F.lit(f"{draw}:"), F.col(row_id).cast("string")), 256)
    rows = vectors.select(name.alias("name"), "_ints").orderBy(F.col("name").asc_nulls_last(), "_ints").limit(k).collect()
    return np.array([r["_ints"] for r in rows], np.int64)


def with_apexes(vectors: DataFrame, row_id: str, simplex: Simplex, size: int) -> DataFrame:
    """``row_id``, ``_ints`` (as int) and ``_apex``; the one pass that measures distances to the pivots."""
    kind = dict(vectors.dtypes)[row_id]

    def projected(batches):
        for batch in _blocks(batches):
            x = _matrix(batch.column(1), size)
            if len(x) and np.abs(x).max() > WIDEST:
                raise ValueError(f"a component beyond {WIDEST} has no exact 64-bit distance")
            apexes = simplex.apexes(squared_distances(x, simplex.pivots))
            ends = np.arange(len(x) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends * size, x.ravel().astype(np.int32)), pa.ListArray.from_arrays(ends * apexes.shape[1], apexes.ravel().astype(np.float32))],
                names=[row_id, "_ints", "_apex"],
            )

    return vectors.select(row_id, "_ints").mapInArrow(projected, f"`{row_id}` {kind}, _ints array<int>, _apex array<float>")


def centroid_sums(prepared: DataFrame, simplex: Simplex, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors: how many, and their sums by component. k rows a task reach the shuffle."""
    k, size = centroids.shape
    theirs = simplex.apexes(squared_distances(centroids, simplex.pivots))

    def summed(batches):
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in _blocks(batches):
            if batch.num_rows:
                x = _matrix(batch.column(0), size).astype(np.int64)
                picked, _ = nearest(x, _matrix(batch.column(1), theirs.shape[1]), centroids, theirs)
                order = np.argsort(picked, kind="stable")
                held, starts = np.unique(picked[order], return_index=True)
                sums[held] += np.add.reduceat(x[order], starts, axis=0)
                counts += np.bincount(picked, minlength=k)
        some = np.flatnonzero(counts)
        ends = np.arange(len(some) + 1, dtype=np.int32) * size
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.ListArray.from_arrays(ends, sums[some].ravel())], names=["cluster", "n", "sums"])

    parts = prepared.select("_ints", "_apex").mapInArrow(summed, "cluster int, n bigint, sums array<bigint>")
    # Decimals: sums of many tasks may leave 64 bits.
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(
        F.sum("n").cast("decimal(38,0)").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).cast("decimal(38,0)").alias("s")
    )
    out: dict[int, tuple[int, list[int]]] = {}
    for r in totals.orderBy("cluster", "at").collect():
        out.setdefault(r["cluster"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out


@dataclass
class Clustering:
    """Fitted centroids (integers), the simplex, and the prepared vectors."""

    centroids: np.ndarray
    simplex: Simplex
    prepared: DataFrame
    row_id: str


def fitted(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, draw: str = "2", pivots: int = PIVOTS) -> Clustering:
    """Start with the drawn vectors; each round assigns every vector and moves non-empty centroids to floor(sum / count)."""
    vectors = integer_vectors(df.select(row_id, vector), vector, size, scale)
    centroids = drawn(vectors, row_id, k, draw).reshape(-1, size)
    if len(centroids) and np.abs(centroids).max() > WIDEST:
        raise ValueError(f"a component beyond {WIDEST} has no exact 64-bit distance")
    simplex = Simplex.of(centroids, pivots)
    prepared = stored(with_apexes(vectors, row_id, simplex, size), "vectors")
    for _ in range(rounds if len(centroids) else 0):
        better = Simplex.of(centroids, pivots)
        if 2 * heights(better, centroids) < heights(simplex, centroids):
            simplex = better
            prepared = stored(with_apexes(prepared, row_id, simplex, size), "vectors")
        moved = centroids.copy()
        for c, (n, sums) in centroid_sums(prepared, simplex, centroids).items():
            moved[c] = [s // n for s in sums]
        centroids = moved
    return Clustering(centroids, simplex, prepared, row_id)


def assigned(model: Clustering) -> DataFrame:
    """One row a vector: its id, cluster and distance (squared)."""
    centroids, simplex, row_id = model.centroids, model.simplex, model.row_id
    kind = dict(model.prepared.dtypes)[row_id]
    theirs = simplex.apexes(squared_distances(centroids, simplex.pivots)) if len(centroids) else np.zeros((0, 1))

    def labelled(batches):
        for batch in _blocks(batches):
            if batch.num_rows:
                x = _matrix(batch.column(1), centroids.shape[1]).astype(np.int64)
                picked, least = nearest(x, _matrix(batch.column(2), theirs.shape[1]), centroids, theirs)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked.astype(np.int32)), pa.array(least)], names=[row_id, "cluster", "distance"])

    return model.prepared.select(row_id, "_ints", "_apex").mapInArrow(labelled, f"`{row_id}` {kind}, cluster int, distance bigint")


def clustered(model: Clustering) -> DataFrame:
    """:func:`assigned` with cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas)."""
    rows = stored(assigned(model), "clusters")
    # One number a centroid.
    inertia = dict(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect())
    k = len(model.centroids)
    own = F.array(*[F.lit(int(inertia.get(c, 0))).cast("long") for c in range(k)]) if k else F.array().cast("array<bigint>")
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in model.centroids.tolist()]) if k else F.array().cast("array<string>")
    at = F.col("cluster") + 1
    return rows.select(
        model.row_id, "cluster", "distance", F.element_at(own, at).alias("cluster_inertia"),
        F.lit(int(sum(inertia.values()))).cast("long").alias("inertia"), F.element_at(names, at).alias("centroid_sha256"),
    )
