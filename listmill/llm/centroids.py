"""Lloyd clustering of integer vectors, with distances filtered in a PCA-rotated space.

Vectors are turned into integers and centroids stay integers, so every result is exact and
the same on any cluster.  The rotation comes from the covariance of all vectors, summed by
Spark.  A vector is stored with its ``lead`` leading rotated coordinates and the norm of all
other ones, its residual.  For a centroid c that is rotated alike

    |x - c|^2  >=  sum over the leading coordinates of (x_i - c_i)^2  +  (residual of x - residual of c)^2

since the residual parts can't be nearer to each other than their norms are.  Each vector is held
in integers against the centroid with the smallest bound, and then only against centroids whose bound isn't
above that distance; the bound gets some room for rounding, so none is missed.

Each round reads the written table, and each task gives one row of sums a cluster.  The driver holds the
centroids (``k`` of them) and the covariance (dims x dims) and nothing that grows with the rows.

Vectors that are null, of another length or with null, infinite or NaN components are dropped.  Repeated rows
count as often as they occur; an empty table gives an empty result, and with fewer than ``k`` vectors each
is a centroid.  A null id sorts behind all others for the first centroids.  Of equally near centroids the smaller number counts.
Integers beyond 2^27 are an error, as distances must fit 64 bits.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.llm.shared import ship, written

LARGEST = 1 << 27
LEAD = 16
CHUNK = 4096  # rows that are held against the centroids at a time


def finite(vector: Column) -> Column:
    """Whether an array has no null, NaN or infinite entry."""
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))


def integer_vectors(df: DataFrame, dims: int, scale: int, key: str, vector: str) -> DataFrame:
    """(id, x): the rows with ``dims`` finite components, each turned into floor(scale * component)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter((F.size("v") == dims) & finite(F.col("v")))
    x = F.transform("v", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("int"))
    return rows.select("id", x.alias("x"))


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def moments(rows: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and covariance of the vectors (id, x); sums of products in floating point, as they only shape the bound."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims, np.float64)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"Integers of vectors have to be within {LARGEST}")
            n, sums = n + len(x), sums + x.sum(axis=0)
            products += x.T @ x
        if n:
            at = np.arange(dims * dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(products.ravel())], ["at", "v"])
            at = np.arange(-dims - 1, 0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(([float(n)], sums[::-1])))], ["at", "v"])

    ship(rows.sparkSession)
    cells = rows.select("x").mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    held = {r.at: r.v for r in cells.collect()}  # dims * dims + dims + 1 cells
    if not held:
        return 0, np.zeros(dims), np.eye(dims)
    n, sums = int(held[-dims - 1]), np.array([held[-1 - i] for i in range(dims)])
    mean = sums / n
    products = np.array([held[i] for i in range(dims * dims)]).reshape(dims, dims)
    return n, mean, products / n - np.outer(mean, mean)


class Rotation:
    """Rotates vectors about their mean; the axes of the largest variance come first."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, lead: int):
        _, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        self.mean, self.axes, self.lead = mean, np.ascontiguousarray(axes[:, ::-1]), lead

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, residual norm, norm."""
        y = (x - self.mean) @ self.axes
        rest = np.sqrt((y[:, self.lead:] ** 2).sum(axis=1))
        return y[:, :self.lead], rest, np.sqrt((y**2).sum(axis=1))


def rotated(rows: DataFrame, rotation: Rotation, dims: int) -> DataFrame:
    """(id, x, lead, rest, norm) of the vectors."""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims, np.float64)
            lead, rest, norm = rotation(x)
            places = pa.array(np.arange(len(x) + 1, dtype=np.int32) * lead.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(places, pa.array(lead.ravel())), pa.array(rest), pa.array(norm)],
                                             ["id", "x", "lead", "rest", "norm"])

    return rows.select("id", "x").mapInArrow(turn, "id bigint, x array<int>, lead array<double>, rest double, norm double")


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, norm: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the squared distance, and how many distances were worked out in integers."""
    c_lead, c_rest, c_norm = rotation(centroids.astype(np.float64))
    bound = np.empty((len(x), len(centroids)))
    for c in range(len(centroids)):
        bound[:, c] = np.sqrt(((lead - c_lead[c]) ** 2).sum(axis=1) + (rest - c_rest[c]) ** 2)

    def distance(rows: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        apart = x[rows] - centroids[c]
        return np.einsum("ij,ij->i", apart, apart)

    cluster = bound.argmin(axis=1)
    best = distance(np.arange(len(x)), cluster)
    first, held = cluster.copy(), len(x)
    for c in range(len(centroids)):
        room = 1e-9 * (norm + c_norm[c] + 1)  # far above the rounding of the bound
        rows = np.flatnonzero((first != c) & (bound[:, c] <= np.sqrt(best) + room))
        if len(rows):
            own = distance(rows, c)
            nearer = (own < best[rows]) | (own == best[rows]) & (c < cluster[rows])
            best[rows[nearer]], cluster[rows[nearer]] = own[nearer], c
            held += len(rows)
    return cluster, best, held


def assignments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, rotation: Rotation) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Parts of batches of the rotated table with their integers, clusters, distances and the number of distances worked out."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            x = matrix(part.column("x"), centroids.shape[1], np.int64)
            lead = matrix(part.column("lead"), rotation.lead, np.float64)
            yield part, x, *nearest(x, lead, part.column("rest").to_numpy(), part.column("norm").to_numpy(), centroids, rotation)


def moved(table: DataFrame, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, int]:
    """One round: the floor of the mean of each centroid's vectors (an empty one stays), and how many distances were worked out."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, held = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for _, x, cluster, _, tried in assignments(batches, centroids, rotation):
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
            held += tried
        own = np.flatnonzero(n)
        if len(own):
            places = pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims)
            tries = np.where(own == own[0], held, 0)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.ListArray.from_arrays(places, pa.array(sums[own].ravel())), pa.array(tries)],
                                             ["cluster", "n", "sums", "tried"])

    parts = table.mapInArrow(add, "cluster int, n bigint, sums array<bigint>, tried bigint")
    every = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"), F.sum("tried").alias("tried"))
    out, held = centroids.copy(), 0
    for r in every.collect():  # k rows
        out[r.cluster] = [s // r.n for s in r.sums]
        held += r.tried
    return out, held


def cluster_vectors(df: DataFrame, dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", lead: int = LEAD,
                    key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a vector: the key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:id``.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, dims, scale, key, vector)
    _, mean, covariance = moments(rows, dims)
    rotation = Rotation(mean, covariance, min(lead, dims))
    table = written(rotated(rows, rotation, dims), "rotated")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = table.select("x", order.alias("o")).orderBy(F.col("o").asc_nulls_last(), "x").limit(k)
    centroids = np.array([r.x for r in first.collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], f"{key} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids, _ = moved(table, centroids, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance, _ in assignments(batches, centroids, rotation):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    out = written(table.mapInArrow(assign, f"{key} bigint, cluster int, distance bigint"), "clusters")
    inertia = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), sha) for c, sha in enumerate(shas)]
    more = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(more), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
