"""Centroid clustering with Elkan's bounds.

Vectors are whole numbers, and so are centroids (componentwise floors of exact
means), so every distance that decides anything is an exact integer. Bounds are
what saves work: each vector keeps an upper bound of the distance to its own
centroid and a lower bound for each other one. A centroid is passed over if
its lower bound, or half its distance to the vector's own centroid, is strictly
above the upper bound; then it is strictly farther, so no tie is lost. Bounds
are floating-point numbers rounded outwards: upper ones up, lower ones down.

A round reads each vector once, where it lies, and writes it with its bounds;
only sums for each cluster travel. Centroids are few and small, and go with the
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, bounded_memory

SCALE = 64
DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
LARGEST = 2.0**62  # quantised components from here on are an error: their sums and distances are no longs
_PLAIN = 1 << 27  # below it squared distances of up to 128 dimensions fit 64 bits
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def exact(values: np.ndarray) -> np.ndarray:
    """The same whole numbers, as Python's where squares would not fit 64 bits."""
    return values.astype(object) if values.size and (int(values.max()) >= _PLAIN or int(values.min()) <= -_PLAIN) else values


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c."""
    d = x - c
    return (d * d).sum(axis=-1)


def _root(d2: np.ndarray, rounding: float) -> np.ndarray:
    return np.sqrt(np.asarray(d2, float)) * rounding


def assign(x: np.ndarray, centroids: np.ndarray, before: tuple[np.ndarray, np.ndarray, np.ndarray] | None, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances computed) of rows of x.

    before: the same three for the last centroids, which have since moved by
    `moved` at most; None computes every distance."""
    n, k = len(x), len(centroids)
    if before is None:
        d2 = np.stack([squared(x, c) for c in centroids], axis=1)
        own = d2.argmin(axis=1)  # the first of equal ones
        rows = np.arange(n)
        return own.astype(np.int32), _root(d2[rows, own], _UP), _root(d2, _DOWN), n * k
    own, upper, lower = before[0].copy(), (before[1] + moved[before[0]]) * _UP, np.maximum(0.0, (before[2] - moved) * _DOWN)
    between = np.stack([_root(squared(centroids, c), 0.5 * _DOWN) for c in centroids])  # halves, rounded down
    open_ = (upper[:, None] >= lower) & (upper[:, None] >= between[own])
    open_[np.arange(n), own] = False
    at = np.flatnonzero(open_.any(axis=1))
    best = squared(x[at], centroids[own[at]])
    upper[at], lower[at, own[at]], computed = _root(best, _UP), _root(best, _DOWN), len(at)
    for j in range(k):
        mine = own[at]
        near = np.flatnonzero((mine != j) & (upper[at] >= lower[at, j]) & (upper[at] >= between[mine, j]))
        if not len(near):
            continue
        rows = at[near]
        d2 = squared(x[rows], centroids[j])
        computed += len(rows)
        lower[rows, j] = _root(d2, _DOWN)
        better = (d2 < best[near]) | ((d2 == best[near]) & (j < own[rows]))
        best[near[better]], own[rows[better]], upper[rows[better]] = d2[better], j, _root(d2[better], _UP)
    return own, upper, lower, computed


def shifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far centroids moved at most."""
    return _root(squared(old, new), _UP)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], column.type.value_type)
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _quantised(width: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False))
            x = _matrix(batch.column(1), width, float)  # nulls become NaN
            with np.errstate(over="ignore"):
                whole = np.floor(x * scale)
            fine = np.isfinite(x).all(axis=1)
            if (np.abs(whole[fine]) >= LARGEST).any():
                raise OverflowError("a component is too large for exact distances")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), _lists(whole[fine].astype(np.int64))], ["vec_id", "v"])

    return of


def _round(centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = exact(_matrix(batch.column("v"), width, np.int64))
            c = centroids.astype(object) if x.dtype == object else centroids
            before = None if moved is None else (batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), k, float))
            own, upper, lower, _ = assign(x, c, before, moved)
            if last:
                d2 = squared(x, c[own])
                if d2.dtype == object and max(d2) >= 2**63:
                    raise OverflowError("a squared distance does not fit 64 bits")
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(d2.astype(np.int64))], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own), pa.array(upper), _lists(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return of


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cluster, n, high, low) for each batch and cluster: sums of components'
    upper and lower 32 bits, which fit 64 bits at any number of rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column("v"), width, np.int64), batch.column("cluster").to_numpy()
            found = np.unique(own)
            if len(found):
                high, low = (np.stack([part[own == j].sum(axis=0) for j in found]) for part in (x >> 32, x & 0xFFFFFFFF))
                counts = np.array([(own == j).sum() for j in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts), _lists(high), _lists(low)], ["cluster", "n", "high", "low"])

    return of


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of the means; empty clusters keep theirs.
    One row for each cluster and dimension comes to the driver."""
    k, width = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(width), "cluster int, n long, high array<long>, low array<long>")
    each = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    total = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    out = centroids.tolist()
    for r in total.collect():
        out[r["cluster"]][r["at"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return exact(np.array(out, np.int64))


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row for each vector that takes part: id_col, cluster, distance
    (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors take part if they have `dimensions` components, none of them null,
    infinite or NaN; components become floor(scale * x). The k vectors with the
    least sha256 of '1:<id>' start as centroids (a null id counts as an empty
    one, ties go to the lesser vector); fewer vectors give fewer centroids. Each
    round assigns all vectors, ties to the smaller number, and moves every
    non-empty centroid to the floor of its mean; then all are assigned again.
    Repeated rows take part, and are counted, each for itself. An empty table
    gives an empty result; other columns are ignored, whatever their names. A
    component of 2**62 or more after scaling, or a sum of distances that does not
    fit 64 bits, is an error.
    """
    spark = vectors.sparkSession
    bounded_memory(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    now = Table(rows.mapInArrow(_quantised(dimensions, scale), "vec_id long, v array<long>"), "vectors")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = exact(np.array([r["v"] for r in now.df.orderBy(digest, "v").limit(k).select("v").collect()], np.int64).reshape(-1, dimensions))
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    moved = None
    for _ in range(rounds):
        after = Table(now.df.mapInArrow(_round(centroids, moved, False), "vec_id long, v array<long>, cluster int, upper double, lower array<double>"), "assigned")
        now.drop()
        now, old = after, centroids
        centroids = _means(now.df, old)
        both = (old.astype(object), centroids.astype(object)) if object in (old.dtype, centroids.dtype) else (old, centroids)
        moved = shifts(*both)
    final = Table(now.df.mapInArrow(_round(centroids, moved, True), "vec_id long, cluster int, distance long"), "distances").df
    now.drop()
    sums = {r["cluster"]: r["total"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # one row a cluster
    digests = [hashlib.sha256(",".join(str(int(c)) for c in row).encode()).hexdigest() for row in centroids]
    inertia = sum(sums.values())
    if inertia >= 2**63:
        raise OverflowError("the sum of all distances does not fit 64 bits")
    of = spark.createDataFrame([(j, total, inertia, digests[j]) for j, total in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(of), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
