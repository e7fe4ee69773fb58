"""Centroid clustering in whole numbers; the nearest centroid is found by the threshold algorithm.

Each dimension has a list of the centroids sorted by their value in it. From a vector's own value every list is
walked outward, the nearer side first. A centroid that is met for the first time gets its exact distance. What no
list has shown yet lies in every dimension at least as far as the next entry of its list, so the walk ends when
the squares of those distances add up to strictly more than the best exact distance: ties are still met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

DIMENSIONS = 64
SCALE = 64
CENTROIDS, ROUNDS = 16, 3
#: Components beyond it, after scaling, could overflow the 64 bits of a distance.
LIMIT = 1 << 26
FAR = 1 << 28
ROWS_AT_ONCE = 2048


class SortedLists:
    """The centroids' values in each dimension in order, with an end beyond all values on both sides."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        k, self.size = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable").T
        inner = np.take_along_axis(centroids.T, order, 1)
        ends = np.full((self.size, 1), FAR)
        self.values = np.concatenate([-ends, inner, ends], axis=1)
        self.owners = np.pad(order, ((0, 0), (1, 1)))
        self.k = k

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each point (the smaller number of equally near
        ones), and how many exact distances each point took."""
        dims = np.arange(self.size)
        after = np.stack([np.searchsorted(v[1:-1], points[:, d]) for d, v in enumerate(self.values)], axis=1) + 1
        before = after - 1
        exact = np.full((len(points), self.k), np.iinfo(np.int64).max)
        seen = np.zeros((len(points), self.k), bool)
        rows = np.arange(len(points))
        while len(rows):
            own, low, high = points[rows], before[rows], after[rows]
            down = own - self.values[dims, low] <= self.values[dims, high] - own
            met = np.zeros((len(rows), self.k), bool)
            met[np.arange(len(rows))[:, None], self.owners[dims, np.where(down, low, high)]] = True
            at, number = np.nonzero(met & ~seen[rows])
            exact[rows[at], number] = ((own[at] - self.centroids[number]) ** 2).sum(axis=1)
            seen[rows] |= met
            low, high = low - down, high + ~down
            before[rows], after[rows] = low, high
            frontier = (np.minimum(own - self.values[dims, np.maximum(low, 0)], self.values[dims, np.minimum(high, self.k + 1)] - own) ** 2).sum(axis=1)
            rows = rows[(frontier <= exact[rows].min(axis=1)) & ~seen[rows].all(axis=1)]
        label = exact.argmin(axis=1)
        return label, np.take_along_axis(exact, label[:, None], 1)[:, 0], seen.sum(axis=1)


def _points(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(first, ROWS_AT_ONCE)
        flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
        yield slice(first, first + ROWS_AT_ONCE), np.floor(flat.reshape(part.num_rows, -1) * SCALE).astype(np.int64)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """`vec_id, embedding` (doubles) of the rows that take part: `DIMENSIONS` components, none of them null or
    non-finite, or beyond `LIMIT` after scaling."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) * SCALE <= LIMIT, F.lit(False)))
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return doubles.where((F.size("embedding") == DIMENSIONS) & fine)


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """Those `k` vectors with the smallest sha256 of `1:<vec_id>`, in that order; rows without id are none of them.
    Rows of one id stand in the order of their components."""
    named = vectors.where("vec_id IS NOT NULL").withColumn("_hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("_hash", "embedding").limit(k).select("embedding").collect()
    return np.floor(np.array([r["embedding"] for r in rows], float).reshape(-1, DIMENSIONS) * SCALE).astype(np.int64)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the exact mean of each cluster's vectors; empty ones stay.

    Every task adds up its own vectors, so a row for each of its clusters is shuffled, and the sums of all
    (centroids times dimensions) come to the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, points in _points(batch):
                label, _, _ = lists.nearest(points)
                np.add.at(total, label, points)
                n += np.bincount(label, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = vectors.mapInArrow(sums, "cluster int, n long, total array<long>")
    parts = parts.select("cluster", "n", F.posexplode("total").alias("dimension", "part"))
    found = parts.groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    out = centroids.copy()
    for r in found.collect():
        out[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`vec_id, cluster, distance` of every row of `whole_vectors`."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            for part, points in _points(batch):
                numbers, distances, _ = lists.nearest(points)
                ids = batch.column("vec_id").slice(part.start, len(points))
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), pa.array(distances)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(label, f"vec_id {kind}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """`vec_id, cluster, distance` of the vectors of `vectors(vec_id, embedding, ...)` that take part, written to
    the shared folder, and the final centroids.

    Components are floors of 64 times their value. Vectors with another number of components than 64, with
    null or non-finite components or with huge ones (`LIMIT`) are left out. A row without id takes part but
    is no first centroid; repeated rows count as often as they stand. Equally near centroids: the smaller
    number. Fewer vectors than `k` give fewer centroids, an empty table none and no rows. Other columns are
    ignored.

    Vectors are never shuffled: a round is a pass that returns sums, and only the centroids, `k` times 64 whole
    numbers, are sent to the tasks.
    """
    fine = whole_vectors(vectors)
    centroids = first_centroids(fine, k)
    if not len(centroids):
        return assigned(fine.limit(0), np.zeros((1, DIMENSIONS), np.int64)), centroids
    for _ in range(rounds):
        centroids = moved_centroids(fine, centroids)
    return materialised(assigned(fine, centroids), "clusters"), centroids


def cluster_report(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `clustered` with `cluster_inertia` and `inertia`, distances summed over the cluster and over
    all, and `centroid_sha256`, of the centroid's components joined by commas."""
    rows, centroids = clustered(vectors, k, rounds)
    sums = {r["cluster"]: int(r["n"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("n")).collect()}
    known = [(c, n, sum(sums.values()), digest(centroids[c])) for c, n in sorted(sums.items())]
    about = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
