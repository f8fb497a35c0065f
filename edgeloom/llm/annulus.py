"""Clusters around centroids, each vector's nearest found by an annulus search on norms.

Centroids are sorted by norm. A vector's distance to a centroid is at least the difference of their norms, so with an upper bound u of the least
distance only centroids whose norm lies within u of the vector's can be nearest or tie: two binary searches name them, and exact distances
of integers decide. u is the exact distance to the nearer of the two centroids whose norms enclose the vector's. Bounds are widened by more than
floating point can err, so no tie at the boundary is missed; ties go to the smaller number.

Vectors are a table of integers that each round reads once; a task sends its sums by cluster, and K centroids (K * 64 numbers) go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Integers beyond this count as it, so that a squared distance fits into a long (64 * 2**56).
MOST = 1 << 27
#: Rows of one comparison.
ROWS = 4_096


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors with exactly `dimensions` components, none null, not a number or infinite; others are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    named = vectors.select("vec_id", x.alias("x"))
    fine = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    kept = named.filter((F.size("x") == dimensions) & fine)
    bound = F.lit(float(MOST))
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(-bound, F.least(bound, c * scale))).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least sha256 of seed:vec_id, in that order; vectors of one vec_id follow by their components."""
    lot = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(lot.alias("lot"), "v").orderBy("lot", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        exact = (centroids.astype(object) ** 2).sum(1) if len(centroids) else np.zeros(0)
        norms = np.sqrt(exact.astype(np.float64))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row of integers, and how many distances were compared."""
        n, k = len(x), len(self.norms)
        own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)

        def compare(rows: np.ndarray, at: int) -> None:
            gap = x[rows] - self.centroids[at]
            far = np.einsum("ij,ij->i", gap, gap)
            closer = (far < best[rows]) | ((far == best[rows]) & (self.number[at] < number[rows]))
            best[rows[closer]], number[rows[closer]] = far[closer], self.number[at]

        enclosing = np.searchsorted(self.norms, own)
        for side in (np.maximum(enclosing - 1, 0), np.minimum(enclosing, k - 1)):
            for at in np.unique(side):
                compare(np.flatnonzero(side == at), at)
        bound = np.sqrt(best.astype(np.float64))
        bound += 1e-9 * (bound + own + 1)
        low, high = np.searchsorted(self.norms, own - bound, "left"), np.searchsorted(self.norms, own + bound, "right")
        for at in range(k):
            inside = np.flatnonzero((low <= at) & (at < high) & (enclosing != at) & (np.maximum(enclosing - 1, 0) != at))
            compare(inside, at)
        return number, best, int((high - low).sum())


def _matrix(batch: pa.RecordBatch, column: str, dimensions: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _moved(kept: DataFrame, centroids: np.ndarray, dimensions: int) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors by component; those without vectors stay."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)  # k * dimensions numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(sent.value)
        k = len(sent.value)
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(at, ROWS), "v", dimensions)
                number, _, _ = search.nearest(x)
                order = np.argsort(number, kind="stable")
                found, starts = np.unique(number[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], starts)
                counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        cells = np.concatenate([counts[some, None], sums[some]], 1)
        place = np.tile(np.arange(dimensions + 1, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dimensions + 1).astype(np.int32)), pa.array(place), pa.array(cells.ravel())], names=["cluster", "place", "total"])

    parts = kept.select("v").mapInArrow(run, "cluster int, place int, total bigint")
    totals = {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}  # k * (dimensions + 1) rows
    made = centroids.copy()
    for c in {c for c, _ in totals}:
        made[c] = [totals[c, j + 1] // totals[c, 0] for j in range(dimensions)]
    return made


def assigned(kept: DataFrame, centroids: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance) of kept vectors."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                number, distance, _ = search.nearest(_matrix(part, "v", dimensions))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("vec_id")), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a kept vector.

    vectors: (vec_id, embedding, ...), other columns are ignored. A vector that is null, of another length, or with a component that is null or not finite has no
    row. Rows of one vec_id are vectors of their own; a null vec_id is hashed as an empty one. With fewer than k vectors each is a centroid. Integers beyond 2**27
    in size count as 2**27. An empty table gives an empty result.
    """
    kept = written(integers(vectors, dimensions, scale), "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = _moved(kept, centroids, dimensions)
    found = written(assigned(kept, centroids, dimensions), "assigned")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    named = [(c, total, sum(sums.values()), ",".join(map(str, centroids[c].tolist()))) for c, total in sorted(sums.items())]
    about = found.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, components string").withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
