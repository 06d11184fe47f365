"""Centroid clustering of integer vectors, exact, with Ptolemaic pivots.

Vectors keep their distances to a few fixed pivots, the starting centroids. For a vector x, a centroid c and a pair
of pivots p, s, Ptolemy's inequality gives |d(x,p) d(c,s) - d(x,s) d(c,p)| / d(p,s) <= d(x,c). Each round takes the
largest such bound over the pivot pairs, rounded down; a centroid whose bound exceeds the exact distance to the most
promising one is ruled out, all others are measured in integers. So assignments and means are exact, ties included.

Vectors and their pivot distances are written once. A round is one pass that returns sums for each partition; only
the sums over all vectors (clusters x components) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components must stay below this, so that squared distances of 64 of them fit 64 bits.
LARGEST = 1 << 27
#: Relative error allowed for in each bound; a double's is under 3e-16 a step.
SLACK = 1e-13
LONGEST = 2**63 - 1


def integer_vectors(vectors: DataFrame, size: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * component) as little-endian 32-bit integers, of vectors of ``size`` finite components."""
    kind = vectors.schema[id_col].dataType.simpleString()
    whole = (F.size("v") == size) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component is {LARGEST / scale:g} or more: its squared distances do not fit a long")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["vec_id", "x"])

    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).where(whole).mapInArrow(run, f"vec_id {kind}, x binary")


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    """Matrix of a column whose values are arrays of one length as bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exact."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    return np.sqrt(np.stack([squared(x, np.broadcast_to(p, x.shape)) for p in pivots], axis=1).astype(np.float64))


def lower_bounds(near: np.ndarray, centres: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Squared Ptolemaic lower bounds, rounded down, of rows (their pivot distances) to centroids (theirs)."""
    low = np.zeros((len(near), len(centres)))
    count = near.shape[1]
    for p in range(count):
        for s in {(p + 1) % count, (p + 3) % count} - {p}:
            if between[p, s] > 0:
                one, other = near[:, p, None] * centres[None, :, s], near[:, s, None] * centres[None, :, p]
                np.maximum(low, (np.abs(one - other) - SLACK * (one + other)) / between[p, s], out=low)
    return low * low * (1 - SLACK)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (the smaller number if two are equally near), its squared distance, and the number of exact distances."""
    low = lower_bounds(near, pivot_distances(centroids, pivots), pivot_distances(pivots, pivots))
    every = np.arange(len(x))
    guess = low.argmin(axis=1)
    exact = np.full(low.shape, LONGEST, np.int64)
    exact[every, guess] = best = squared(x, centroids[guess])
    open_ = low <= best[:, None]
    open_[every, guess] = False
    row, centre = np.nonzero(open_)
    exact[row, centre] = squared(x[row], centroids[centre])
    cluster = exact.argmin(axis=1)
    return cluster, exact[every, cluster], len(x) + len(row)


def first_centroids(kept: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of the smallest sha256 of ``salt:id``, in that order; null ids come last, ties by the vector's bytes."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in rows], np.int64)


def _sums(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and component sums of each cluster that is not empty."""
    size, count = centroids.shape[1], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0), "<i4").astype(np.int64)
                cluster, _, _ = nearest(x, rows_of(batch.column(1), "<f8"), centroids, pivots)
                number += np.bincount(cluster, minlength=count)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(axis=0)
        used = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([[int(number[c]), *total[c].tolist()] for c in used], pa.list_(pa.int64()))], ["cluster", "sums"])

    each = cached.select("x", "near").mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums"))
    out: dict[int, dict[int, int]] = {}
    for r in each.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(28,0)")).alias("n")).collect():
        out.setdefault(r.cluster, {})[r.pos] = int(r.n)
    return {c: (v[0], [v[k] for k in range(1, size + 1)]) for c, v in out.items()}


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: float = 1024.0, salt: str = "3",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, stored, and the final centroids.

    Vectors that are null, of another size, or with null or non-finite components are not kept. Each row counts as a
    vector, repeated rows and null ids too (a null id starts no centroid while others are left). With fewer vectors than
    ``clusters`` there are as many clusters as vectors. Empty tables give an empty result. Other columns are not read.
    """
    kept = common.stored(integer_vectors(vectors, size, scale, id_col, vector_col), "cluster-vectors")
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = pivots = first_centroids(kept, clusters, salt)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64)

    def remember(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pivot_distances(rows_of(batch.column(1), "<i4").astype(np.int64), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in near.astype("<f8")], pa.binary())], ["vec_id", "x", "near"])

    cached = common.stored(kept.mapInArrow(remember, f"vec_id {kind}, x binary, near binary"), "cluster-pivots")
    for _ in range(rounds):
        for c, (number, total) in _sums(cached, centroids, pivots).items():
            centroids = centroids.copy()
            centroids[c] = [t // number for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = nearest(rows_of(batch.column(1), "<i4").astype(np.int64), rows_of(batch.column(2), "<f8"), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return common.stored(cached.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "cluster-assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia (sums of distances; at most the largest long) and centroid_sha256."""
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)"))).collect()}
    if not sums:
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = F.create_map(*[F.lit(v) for c, n in sums.items() for v in (c, min(n, LONGEST))])
    digest = F.create_map(*[F.lit(v) for c in sums for v in (c, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())])
    return assigned.select("*", own[F.col("cluster")].cast("long").alias("cluster_inertia"), F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"),
                           digest[F.col("cluster")].alias("centroid_sha256"))
