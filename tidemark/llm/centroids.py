"""Clusters around centroids: single-precision products shortlist, exact integers decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, frugal

#: Components of this size are refused: beyond it a squared distance of 64 of them may not fit in a long.
LARGEST = 1 << 27
#: Rows that meet the centroids at once inside a task.
TILE = 4096
#: Unit roundoff of single precision.
UNIT = 2.0**-24


def whole_numbers(rows: DataFrame, vector: str, scale: int, largest: int) -> DataFrame:
    """The ``rows`` whose vector has neither a null nor a component that isn't finite, with each component x as floor(scale * x).

    A component that comes to ``largest`` or more stops the job: what follows would not be exact."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))

    def whole(x: Column) -> Column:
        refused = F.raise_error(F.lit(f"a component times {scale} reaches {largest}")).cast("int")
        return F.when(F.abs(scaled(x)) < float(largest), F.floor(scaled(x)).cast("int")).otherwise(refused)

    return rows.where(finite).withColumn(vector, F.transform(vector, whole))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of integer lists of ``size`` as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the centroid nearest to each row of ``x`` (integers); the least number of those that are as near.

    Distances are compared without the row's own square: |c|^2 - 2 x.c. The product is taken in single precision. With d
    components its error is at most g |x| |c| for g = (d + 2) u / (1 - (d + 2) u), whatever the order of its sums: d
    products and sums, and one rounding of each factor. The rest is done in double precision, whose error 2^-50 of the
    terms' size covers. Centroids whose interval reaches below the least upper end are the shortlist; where that has more
    than one, their distances are computed in integers.
    """
    d = x.shape[1]
    g = (d + 2) * UNIT / (1 - (d + 2) * UNIT)
    own = np.einsum("ij,ij->i", centroids, centroids).astype(np.float64)
    sizes = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))[:, None] * np.sqrt(own)[None, :] * (1 + 2.0**-30)
    value = own[None, :] - 2.0 * (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    error = 2.0 * g * sizes + 2.0**-50 * (own[None, :] + 4.0 * sizes)
    short = value - error <= (value + error).min(axis=1, keepdims=True)
    best = short.argmax(axis=1)
    unsure = np.flatnonzero(short.sum(axis=1) > 1)
    if unsure.size:
        at, c = np.nonzero(short[unsure])
        exact = np.full((unsure.size, len(centroids)), np.iinfo(np.int64).max)
        exact[at, c] = squared(x[unsure[at]], centroids[c])
        best[unsure] = exact.argmin(axis=1)
    return best


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    apart = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", apart, apart)


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, TILE):
            part = b.slice(i, TILE)
            yield part, matrix(part.column(1), size)


def _moved(points: DataFrame, centroids: np.ndarray, vector: str) -> np.ndarray:
    """Each centroid moved to the floor of the mean of the points nearest to it; one without points stays.

    A task adds up its own points and gives a row for each centroid and component at most; k times d sums reach the driver."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, x in _tiles(batches, size):
            near = nearest(x, centroids)
            for c in np.unique(near):
                total[c] += x[near == c].sum(axis=0, dtype=np.int64)
            n += np.bincount(near, minlength=k)
        used = np.flatnonzero(n)
        c, i = np.repeat(used, size), np.tile(np.arange(size), used.size)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(i, pa.int64()), pa.array(total[c, i]), pa.array(n[c])], ["c", "i", "total", "n"])

    parts = points.select(F.lit(0).alias("zero"), vector).mapInArrow(frugal(run), "c long, i long, total long, n long")
    sums = parts.groupBy("c", "i").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    moved = centroids.copy()
    for row in sums.collect():
        moved[row.c, row.i] = int(row.total) // row.n
    return moved


def cluster(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``key``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` for each vector.

    Vectors of exactly ``size`` finite components take part, as integers floor(scale * x); others (null, shorter, longer, with
    a null inside) are left out. The first centroids are the ``k`` vectors of the least SHA-256 of ``seed:key``; in each of
    ``rounds`` every vector goes to the nearest (see ``nearest``) and every centroid to the floor of its vectors' mean; after
    the last one vectors are assigned once more. All is exact, and refused where it can't be (LARGEST).

    Each round is one narrow pass over the integers, written once, and a sum of a row for each task, centroid and component:
    no vector is shuffled, so neither a hot cluster nor a group of equal vectors is anybody's burden. The driver holds k
    centroids. Fewer vectors than ``k`` give as many centroids; an empty table gives no rows. Repeated keys are vectors of
    their own; those that share a least hash are ordered by components. A null key is assigned, but never a first centroid.
    Only ``key`` and ``vector`` are read, so other columns can have any name.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "centroids")
    named = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("x")).where(F.size("x") == size)
    points = scratch.keep("points", whole_numbers(named, "x", scale, LARGEST))
    chosen = points.where("key IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256).alias("h"), "x")
    first = chosen.orderBy("h", "x").limit(k).collect()
    kind = named.schema["key"].dataType.simpleString()
    if not first:
        return points.select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = np.array([r.x for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(points, centroids, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _tiles(batches, size):
            near = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near.astype(np.int32)), pa.array(squared(x, centroids[near]))], ["key", "cluster", "distance"])

    placed = scratch.keep("placed", points.select("key", "x").mapInArrow(frugal(run), f"key {kind}, cluster int, distance long"))
    sums = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    names = F.sha2(of([",".join(map(str, c)) for c in centroids.tolist()]), 256)
    each = of([sums.get(c, 0) for c in range(len(centroids))]).cast("long")
    return placed.select(F.col("key").alias(key), "cluster", "distance", each.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), names.alias("centroid_sha256"))
