"""Centroid clustering in integers, with PCA-rotated filtering of the centroids that a vector may belong to.

Vectors are stored once with their leading coordinates in the basis of the covariance's eigenvectors and the norm of
the rest. The squared distance of the leading parts plus the squared difference of the norms is never above the
squared distance of two vectors. So most centroids are ruled out by a few coordinates, and only those whose bound
does not exceed the best distance are compared in full, in integers. Assignments, sums and centroids are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.session import materialize

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2

#: Coordinates that the bound uses, of which the rest is known by its norm only.
LEADING = 16

#: Components from here on leave 64 bits once squared and summed; they are computed in unbounded integers.
WIDE = 1 << 27
#: Components from here on are taken for no number.
TOO_LARGE = float(1 << 62)


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the components times ``scale`` rounded down, of the vectors that can be clustered."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    sound = F.forall("y", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(TOO_LARGE)))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("y"))
        .where((F.size("y") == dimensions) & sound)
        .select("vec_id", F.transform("y", lambda y: F.floor(y).cast("long")).alias("v"))
    )


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def principal_axes(rows: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and eigenvectors of the covariance by falling variance, from sums that every task adds up for itself."""
    schema = pa.schema([("i", pa.int32()), ("s", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            v = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch, "v", dimensions).astype(float)])
            total += v.T @ v
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], schema=schema)

    found = rows.select("v").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((dimensions + 1) ** 2)
    for row in found:
        total[row["i"]] = row["s"]
    total = total.reshape(dimensions + 1, -1)
    if not total[0, 0]:
        return np.zeros(dimensions), np.eye(dimensions)
    mean = total[0, 1:] / total[0, 0]
    covariance = total[1:, 1:] / total[0, 0] - np.outer(mean, mean)
    return mean, np.linalg.eigh(covariance)[1][:, ::-1]


def _rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    y = (v.astype(float) - mean) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(1))


def rotated_vectors(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, leading: int = LEADING) -> DataFrame:
    """``rows`` with ``lead``, the leading rotated coordinates, and ``rest``, the norm of the others."""
    fields = [("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("lead", pa.list_(pa.float64())), ("rest", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, rest = _rotated(_matrix(batch, "v", len(mean)), mean, axes, leading)
                ends = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(lead.ravel()))
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), lists, pa.array(rest)], schema=schema)

    return rows.mapInArrow(run, "vec_id long, v array<long>, lead array<double>, rest double")


def squared_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact; unbounded integers where 64 bits might not do."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) >= WIDE:
        v, c = v.astype(object), c.astype(object)
    return ((v - c) ** 2).sum(-1)


class Centroids:
    """Centroids with their rotated form, to find the nearest of them."""

    def __init__(self, vectors: list[list[int]], mean: np.ndarray, axes: np.ndarray, leading: int = LEADING):
        self.v = np.asarray(vectors, np.int64)
        self.lead, self.rest = _rotated(self.v, mean, axes, leading)
        self.verified = 0

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Below the squared distance to each centroid by more than what rounding adds."""
        own, other = (lead**2).sum(1) + rest**2, (self.lead**2).sum(1) + self.rest**2
        products = lead @ self.lead.T + np.outer(rest, self.rest)
        sums = own[:, None] + other
        return sums - 2 * products - 1e-9 * (sums + 1)

    def nearest(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smallest of equally near ones) and squared distance."""
        low = self.bounds(lead, rest)
        label = low.argmin(1)
        best = squared_distances(v, self.v[label])
        self.verified += len(v)
        low[np.arange(len(v)), label] = np.inf
        for k in np.flatnonzero((low <= best[:, None].astype(float)).any(0)).tolist():
            at = np.flatnonzero(low[:, k] <= best.astype(float))
            self.verified += len(at)
            found = squared_distances(v[at], self.v[k])
            nearer = (found < best[at]) | (found == best[at]) & (k < label[at])
            if found.dtype != best.dtype:
                best = best.astype(object)
            best[at[nearer]], label[at[nearer]] = found[nearer], k
        return label, best


def _assigned(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[tuple]:
    dimensions, leading = centroids.v.shape[1], centroids.lead.shape[1]
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch, "v", dimensions)
            yield batch, v, *centroids.nearest(v, _matrix(batch, "lead", leading), batch.column("rest").to_numpy())


def moved(stored: DataFrame, centroids: Centroids) -> list[list[int]]:
    """The centroids after one round: means of their vectors, rounded down; those without vectors stay."""
    schema = pa.schema([("cluster", pa.int32()), ("i", pa.int32()), ("s", pa.decimal128(38, 0))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids.v), centroids.v.shape[1] + 1), object)
        for _, v, label, _ in _assigned(batches, centroids):
            v = v if np.abs(v).max() < WIDE else v.astype(object)
            for k in np.unique(label).tolist():
                own = v[label == k]
                total[k] += np.asarray([len(own), *own.sum(0).tolist()], object)
        k, i = np.indices(total.shape, np.int32)
        values = pa.array([Decimal(int(s)) for s in total.ravel()], schema.field("s").type)
        yield pa.record_batch([pa.array(k.ravel()), pa.array(i.ravel()), values], schema=schema)

    found = stored.select("v", "lead", "rest").mapInArrow(sums, "cluster int, i int, s decimal(38,0)")
    total = [[0] * (centroids.v.shape[1] + 1) for _ in centroids.v]
    for row in found.groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect():
        total[row["cluster"]][row["i"]] = int(row["s"])
    return [[s // n for s in sums] if n else old for (n, *sums), old in zip(total, centroids.v.tolist())]


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    leading: int = LEADING,
) -> DataFrame:
    """``vec_id``, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and the ``centroid`` of every
    vector of ``dimensions`` finite components in ``embedding``.

    Other vectors are left out, and so are those with a scaled component of 2^62 or more. The first centroids are
    the vectors whose id has the smallest sha256, by vector among equal ids; a null id counts as an empty one. With
    fewer vectors than ``clusters`` each starts one. Repeated rows are vectors of their own. Distances and sums
    that 64 bits cannot hold are null. An empty table gives an empty one. Further columns are left out.

    To the driver come the first centroids, the sums of each round (clusters by components) and one row a cluster.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, dimensions)
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in whole.select("v", order.alias("by")).orderBy("by", "v").limit(clusters).collect()]
    mean, axes = principal_axes(whole, dimensions)
    stored = materialize(rotated_vectors(whole, mean, axes, leading), "vectors")
    if not first:
        fields = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], fields)
    centroids = Centroids(first, mean, axes, leading)
    for _ in range(rounds):
        centroids = Centroids(moved(stored, centroids), mean, axes, leading)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found, distance in _assigned(batches, centroids):
            fits = [int(d) if d < 1 << 63 else None for d in distance] if distance.dtype == object else distance
            columns = pa.array(found.astype(np.int32)), pa.array(fits, pa.int64())
            yield pa.record_batch([batch.column("vec_id"), *columns], schema=schema)

    labelled = materialize(stored.mapInArrow(label, "vec_id long, cluster int, distance long"), "labels")
    found = labelled.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")
    )
    inertia = {r["cluster"]: r["s"] for r in found.collect()}
    whole_sum = None if None in inertia.values() else sum(inertia.values())
    fits = lambda s: int(s) if s is not None and s < 1 << 63 else None
    told = [(k, fits(s), fits(whole_sum), centroids.v[k].tolist()) for k, s in inertia.items()]
    by_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # a row per centroid
    return labelled.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", *by_cluster.columns[1:])
