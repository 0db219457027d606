"""Clustering around centroids by an equal-average equal-variance search (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemart.session import settle

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
LONG_MAX = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and vector, floor(scale * x) of each component x as double, of every row whose embedding has exactly
    ``dims`` components, none of them null or non-finite. A component beyond 64 bits becomes the nearest 64-bit number."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    return (
        embeddings.select("vec_id", "embedding").filter(F.size("embedding") == dims).filter(sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
    )


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:vec_id``, in that order; rows of one vec_id by their components,
    rows without vec_id last. Fewer rows than clusters give fewer centroids."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select(name.alias("name"), "vector").orderBy(F.asc_nulls_last("name"), "vector").limit(clusters)
    return np.array([r.vector for r in chosen.collect()], object)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


class Centroids:
    """Centroids sorted by the sum of their components, searched outward from a vector's own sum.

    With S the sum and V the deviation of the d components, the squared distance of x and c is at least
    (S(x) - S(c))^2 / d + (V(x) - V(c))^2. The sums are whole, so the first part is tested exactly and ends the scan of a
    side; the second is tested with a margin for rounding and skips one centroid. What is left is measured in whole
    numbers. Components too large for that in 64 bits are handled as Python integers by the same steps.
    """

    def __init__(self, centroids: np.ndarray):
        self.k, self.dims = centroids.shape
        self.order = np.argsort(centroids.sum(1), kind="stable")
        self.sorted = centroids[self.order]
        self.sums = self.sorted.sum(1)
        self.reach = max((abs(int(v)) for v in centroids.ravel()), default=0)

    @staticmethod
    def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.square(x - (sums.astype(np.float64) / x.shape[1])[:, None]).sum(1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each row (of equally near ones the smallest), squared distance, and how many
        distances were measured."""
        reach = max(self.reach, int(max(x.max(initial=0), -int(x.min(initial=0)))))
        kind = np.int64 if 2 * reach * self.dims < 1 << 31 else object
        x, centroids, sums = x.astype(kind), self.sorted.astype(kind), self.sums.astype(kind)
        own = x.sum(1)
        out_x, out_c = self._deviation(x, own), self._deviation(centroids, sums)
        n = len(x)
        best = np.full(n, self.dims * (2 * reach + 1) ** 2, kind)
        number = np.full(n, self.k, np.int64)
        high = np.searchsorted(sums, own).astype(np.int64)
        low = high - 1
        live, measured = np.arange(n), 0
        while len(live):
            up, down = high[live], low[live]
            gap_up = np.where(up < self.k, sums[np.minimum(up, self.k - 1)] - own[live], -1)
            gap_down = np.where(down >= 0, own[live] - sums[np.maximum(down, 0)], -1)
            rising = (gap_up >= 0) & ((gap_down < 0) | (gap_up <= gap_down))
            gap = np.where(rising, gap_up, gap_down)
            near = (gap >= 0) & (gap * gap <= self.dims * best[live])  # of both sides the nearer: beyond it all are farther
            live, at, rising, gap = live[near], np.where(rising, up, down)[near], rising[near], gap[near]
            high[live[rising]] += 1
            low[live[~rising]] -= 1
            least = gap.astype(np.float64) ** 2 / self.dims + (out_x[live] - out_c[at]) ** 2
            some = least <= best[live].astype(np.float64) * (1 + 1e-9) + 1e-3
            rows, at = live[some], at[some]
            step = x[rows] - centroids[at]
            away = (step * step).sum(1)
            measured += len(rows)
            name = self.order[at]
            better = (away < best[rows]) | ((away == best[rows]) & (name < number[rows]))
            best[rows[better]], number[rows[better]] = away[better], name[better]
        return number, best, measured


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floors of their vectors' means. Tasks hand on one sum per cluster and component."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dims)
            number, _, _ = search.nearest(x)
            exact = x if int(np.abs(x.astype(np.float64)).max()) < 1 << 40 else x.astype(object)
            for c in np.unique(number):
                rows = number == c
                total[c] += exact[rows].sum(0)
                count[c] += int(rows.sum())
        filled = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(filled, dims), pa.int32()), "place": pa.array(np.tile(np.arange(dims), len(filled)), pa.int32()),
            "n": pa.array(np.repeat(count[filled], dims), pa.int64()),
            "total": pa.array([Decimal(int(v)) for v in total[filled].ravel()], pa.decimal128(38, 0))})

    parts = vectors.select("vector").mapInArrow(run, "cluster int, place int, n long, total decimal(38,0)")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared; beyond 64 bits the largest of them) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            number, away, _ = search.nearest(_matrix(batch.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "cluster": pa.array(number, pa.int32()),
                "distance": pa.array(np.minimum(away, LONG_MAX).astype(np.int64), pa.int64())})

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row that ``whole_vectors`` keeps.

    Each round assigns every vector to its nearest centroid, then moves the centroids; empty ones stay. Only the
    centroids (clusters x dims numbers) travel to the driver and back. Repeated rows each count and get a result each;
    rows without vec_id are clustered too; equal distances fall to the smaller cluster. Other vectors are left out. An
    empty table gives no rows. Extra columns are not read. Inertias beyond 64 bits become the largest 64-bit number.
    """
    vectors = settle(whole_vectors(embeddings, dims, scale), "centroids-vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), object)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    placed = settle(assign(vectors, centroids), "centroids-assigned")
    within = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [
        (c, min(within.get(c, 0), LONG_MAX), min(sum(within.values()), LONG_MAX), hashlib.sha256(",".join(str(int(v)) for v in own).encode()).hexdigest())
        for c, own in enumerate(centroids)]
    facts = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per cluster
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
