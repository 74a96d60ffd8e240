"""Rounds of centroids over integer vectors, where each vector finds its nearest centroid by the threshold algorithm.

Every dimension has the centroids in a list, sorted by their value there. A vector walks each list outward from its own value, the nearer neighbour
first, one centroid of every list in a step. Centroids met for the first time get their exact distance. What no list has shown yet differs in every dimension by at least
as much as that list's last step, so it is no nearer than the sum of the squares of these steps. Once that sum is strictly above the
best exact distance the vector is done; a sum equal to it is not enough, for ties go to the smaller number.

Vectors stay where they are. A round gives each task the centroids (``k`` times ``dims`` integers), and takes back a sum for each centroid and dimension
from each task, summed up by Spark and divided exactly on the driver: ``k`` times ``dims`` rows, whatever the number of vectors.

Vectors take part that have exactly ``dims`` components, none null, NaN or infinite, of at most 2^27 after scaling, so that a distance fits 64 bits; larger
ones are an error. The first centroids are those of the smallest hashes; of vectors with equal ids the one of smaller components comes first,
and null ids come last. Fewer vectors than ``k`` make so many centroids. Repeated vectors count each. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, tidy

K, DIMS, ROUNDS, SCALE, SALT = 8, 64, 10, 1024, 3
#: Vectors of one step of the search, and the largest component.
ROWS, MOST = 2048, 1 << 27


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, q): whole numbers of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & fine)
    whole = lambda x: F.floor(x * scale)
    return rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x * scale) < MOST, whole(x)).otherwise(F.raise_error(F.lit("component too large")))).alias("q"))


class SortedLists:
    """The centroids of each dimension in the order of their values there."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()  # a row for each dimension
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row the number of its nearest centroid, the squared distance, and how many distances were computed for all."""
        n, (k, dims) = len(x), self.centroids.shape
        right = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], 1)  # the next centroid at or above the value
        left = right - 1
        best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        seen, active, cost = np.zeros((n, k), bool), np.arange(n), 0
        lanes, far = np.arange(dims)[None, :], np.iinfo(np.int64).max
        while len(active):
            a, lo, hi = x[active], left[active], right[active]
            below = np.where(lo >= 0, a - self.values[lanes, np.maximum(lo, 0)], far)
            above = np.where(hi < k, self.values[lanes, np.minimum(hi, k - 1)] - a, far)
            down = below <= above
            frontier = np.where(down, below, above)
            met = self.order[lanes, np.where(down, np.maximum(lo, 0), np.minimum(hi, k - 1))]
            left[active], right[active] = lo - down, hi + ~down
            fresh = np.zeros((len(active), k), bool)
            fresh[np.arange(len(active))[:, None], met] = True
            fresh &= ~seen[active]
            seen[active] |= fresh
            row, centroid = np.nonzero(fresh)  # of a row in ascending order of the centroids
            cost += len(row)
            gap = a[row] - self.centroids[centroid]
            distance = np.einsum("ij,ij->i", gap, gap)
            table = np.full(fresh.shape, far)
            table[row, centroid] = distance
            c = table.argmin(1)
            d = table[np.arange(len(active)), c]
            better = (d < best[active]) | ((d == best[active]) & (c < which[active]))
            best[active], which[active] = np.where(better, d, best[active]), np.where(better, c, which[active])
            bound = np.einsum("ij,ij->i", frontier, frontier)
            active = active[(bound <= best[active]) & ~seen[active].all(1)]
        return which, best, cost


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: of each its vectors' mean, rounded down, or itself where it has none."""
    lists, (k, dims) = SortedLists(centroids), centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in slices(batches, ROWS):
            x = _matrix(b.column(0), dims)
            which, _, _ = lists.nearest(x)
            np.add.at(total, which, x)
            count += np.bincount(which, minlength=k)
        cluster, dim = np.divmod(np.arange(k * dims), dims)
        ok = count[cluster] > 0
        columns = [cluster[ok].astype(np.int32), dim[ok].astype(np.int32), total.ravel()[ok], count[cluster][ok]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "dim", "total", "n"])

    sums = vectors.select("q").mapInArrow(tidy(work), "cluster int, dim int, total long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    out = centroids.copy()
    for r in sums.groupBy("cluster", "dim").agg(*wide).collect():  # k times dims rows
        out[r.cluster, r.dim] = int(r.total) // int(r.n)
    return out


def seeds(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors with the smallest hashes, in that order."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("q", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()  # k rows
    return np.array([r.q for r in first], np.int64)


def clustered(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, salt: int = SALT
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    vectors = stored(kept_vectors(df, id_col, vec_col, dims, scale), "vectors")
    centroids = seeds(vectors, k, salt)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        extra = [F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *extra, F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    lists = SortedLists(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            which, distance, _ = lists.nearest(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(vectors.select("vec_id", "q").mapInArrow(tidy(work), schema), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, s, sum(sums.values()), shas[c]) for c, s in sums.items()]
    about = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
