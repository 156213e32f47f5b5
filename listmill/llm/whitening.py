"""Whitening of embeddings along the leading eigenvectors of their covariance.

Spark sums the integer vectors and, centred on the integers next to the means, their products: exactly, so the
covariance doesn't depend on how rows are dealt.  The driver gets dims x dims sums, never rows, and finds the leading
eigenpairs by contour integration (:mod:`listmill.llm.feast`).  Every vector is then projected where it lies.
The covariance of what came out is summed by Spark once more and held against the identity.

A vector is dropped if it is null or has null, NaN or infinite entries.  All vectors need the same length: if they
differ, the most frequent length counts (of equally frequent ones the longest) and others are dropped.  An empty vector has no component and no row.
Directions without variance (below 1e-13 of the trace) can't be whitened and have no component; so a single vector, or copies of
one, give an empty result, as does an empty table.  Repeated rows are all returned.  A null id stays null.  ``deviation`` is null where it doesn't fit
64 bits.  Dimensions beyond MOST_DIMENSIONS are an error.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.llm.centroids import finite, matrix
from listmill.llm.feast import leading_pairs
from listmill.llm.shared import ship, written

MOST_DIMENSIONS = 2048
EXACT = 1 << 20  # up to here products of CHUNK rows are exact in floating point
CHUNK = 4096


def integer_rows(df: DataFrame, scale: int, shift: int, key: str, vector: str) -> DataFrame:
    """(id, x): the finite vectors with floor(scale * entry) + shift as entries."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter((F.size("v") > 0) & finite(F.col("v")))
    return rows.select("id", F.transform("v", lambda v: F.floor(F.lit(scale) * v.cast("double")) + F.lit(shift)).alias("x"))


def usual_length(rows: DataFrame) -> int:
    """The most frequent length; 0 if there are no rows.  One row a length comes to the driver's top-1."""
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each entry."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column(0), dims, np.int64)
            fits = np.abs(x).max(initial=0) < (1 << 62) // max(len(x), 1)
            n, sums = n + len(x), sums + (x if fits else x.astype(object)).sum(axis=0).astype(object)
        if n:
            yield _cells(np.arange(dims + 1), [n, *sums.tolist()])

    held = _summed(rows.select("x"), add)
    return held.get(0, 0), [held.get(i + 1, 0) for i in range(dims)]


def _cells(at: np.ndarray, values: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["at", "v"])


def _summed(rows: DataFrame, add) -> dict[int, int]:
    """Sums of the cells that the tasks give; there are at most dims * (dims + 1)."""
    ship(rows.sparkSession)
    return {r.at: int(r.v) for r in rows.mapInArrow(add, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()}


def covariance(rows: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor ``n``, from exact sums of products of entries centred on integers."""
    centre = np.array([s // n for s in sums], object)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, middle = np.zeros((dims, dims), object), centre.astype(np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                z = matrix(batch.column(0).slice(start, CHUNK), dims, np.int64) - middle
                if np.abs(z).max(initial=0) <= EXACT:
                    products = products + np.rint(z.astype(float).T @ z.astype(float)).astype(np.int64).astype(object)
                else:
                    products = products + z.astype(object).T.dot(z.astype(object))
        upper = np.flatnonzero(np.triu(np.ones((dims, dims), bool)))
        if products.any():
            yield _cells(upper, products.ravel()[upper].tolist())

    held = _summed(rows.select("x"), add)
    left = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = float(Fraction(n * held.get(i * dims + j, 0) - left[i] * left[j], n * n))
    return out


def projector(sums: list[int], n: int, e: np.ndarray, v: np.ndarray):
    """A function from integer vectors to whitened ones."""
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s - n * int(c), n)) for s, c in zip(sums, centre)])
    turn = v / np.sqrt(e)
    return lambda x: ((x - centre) - rest) @ turn


def identity_error(rows: DataFrame, dims: int, n: int, project, count: int) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = project(matrix(batch.column(0), dims, np.int64))
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count * (count + 1), dtype=np.int32)), pa.array(np.append(products.ravel(), sums))], ["at", "v"])

    cells = rows.select("x").mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # count * (count + 1)
    held = np.array([v for _, v in sorted((r.at, r.v) for r in cells)])
    mean = held[count * count:] / n
    return float(np.abs(held[:count * count].reshape(count, count) / n - np.outer(mean, mean) - np.eye(count)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n * x - S)^2 of each vector."""
    centre = np.array([s // n for s in sums], np.int64)
    z, rest = x - centre, np.array([s - n * (s // n) for s in sums], object)
    most = n * (int(np.abs(z).max(initial=0)) + 1)
    if most * most * len(sums) < 1 << 62:
        y = z * n - rest.astype(np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    exact = [sum((int(a) * n - b) ** 2 for a, b in zip(row, rest)) for row in z.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: the key, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    schema = f"{key} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = written(integer_rows(df, scale, shift, key, vector), "vectors")
    dims = usual_length(rows)
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"Vectors may have at most {MOST_DIMENSIONS} dimensions")
    rows = rows.filter(F.size("x") == dims)
    n, sums = column_sums(rows, dims) if dims else (0, [])
    v = covariance(rows, dims, n, sums) if n else np.zeros((0, 0))
    trace = float(np.trace(v))
    e, axes = leading_pairs(v, components, 1e-13 * trace) if trace > 0 else (np.empty(0), np.empty((dims, 0)))
    if not len(e):
        return spark.createDataFrame([], schema)
    project = projector(sums, n, e, axes)
    error, count, explained = identity_error(rows, dims, n, project, len(e)), len(e), e / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                x = matrix(part.column(1), dims, np.int64)
                at = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * count, n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(at), pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * count, error))], [c.split(" ")[0] for c in schema.split(", ")])

    return rows.mapInArrow(emit, schema)
