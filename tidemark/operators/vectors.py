"""Similarity of vectors: an exact search, and one by an index of lists around centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds while queries pass by, at most, and queries that meet them at once: their scores, held three times over, take 100 MB.
SEGMENT, QUERIES = 1 << 16, 64
#: Lists of an index at most, rows for each that its centroids are fitted on, and rounds of fitting: what is collected for
#: an index, and sent to tasks with it, is bounded by these.
MOST_LISTS, FIT_ROWS, FIT_ROUNDS = 4096, 32, 8
#: Queries that choose how many lists are opened.
PROBE_QUERIES = 200
#: Rows that meet an index's centroids at once inside a task: scores and their order take 50 MB.
TILE = 512


#: More than a product of vectors of length 1 may be off in double precision.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of the same length."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(``key``, ``unit``): vectors of length 1. Those with a null or no direction have no similarity and are left out."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    own = rows.select(F.col(f"`{key}`").alias("key"), x.alias("x")).withColumn("length", F.sqrt(dot(F.col("x"), F.col("x"))))
    own = own.where((F.col("length") > 0) & (F.col("length") < float("inf")))
    return own.select("key", F.transform("x", lambda v: v / F.col("length")).alias("unit"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _meet(rows: DataFrame, asked: DataFrame, k: int, parts: int, most: int) -> DataFrame:
    """The ``k`` best of each part for each query that asks it: (query, key, score).

    ``rows`` has list, segment, key and unit; ``asked`` list, segment, query and unit. Both are dealt by part; a task holds the
    rows of one part, which are bounded, and takes the queries that follow in blocks of ``most``, each as one matrix product.
    """
    kind = rows.schema["key"].dataType.simpleString()
    both = rows.select("list", "segment", F.lit(0).alias("asks"), "key", "unit").unionByName(asked.select("list", "segment", F.lit(1).alias("asks"), F.col("query").alias("key"), "unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, keys, x = None, [], None, None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in ("list", "segment", "asks")])
            edges = np.flatnonzero((np.diff(place, axis=1) != 0).any(axis=0)) + 1
            for a, z in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if a == z:
                    continue
                if tuple(place[:2, a]) != at:
                    at, held, keys, x = tuple(place[:2, a]), [], None, None
                if not place[2, a]:
                    held.append(b.slice(a, z - a))
                    continue
                if x is None and held:
                    keys, x, held = pa.concat_arrays([h.column("key") for h in held]), np.concatenate([_matrix(h.column("unit")) for h in held]), []
                    order = pc.sort_indices(keys).to_numpy()
                    keys, x = keys.take(order), x[order]  # a stable order by score then leaves the least key first
                if x is None:
                    continue
                for p in range(a, z, most):
                    q = b.slice(p, min(most, z - p))
                    asking = _matrix(q.column("unit"))
                    score = asking @ x.T
                    few = min(k + 1, score.shape[1])  # one more, as the query itself may be among them
                    least = -np.partition(-score, few - 1, axis=1)[:, few - 1 : few]
                    i, j = np.nonzero(score >= least - SLACK)
                    exact = np.einsum("ij,ij->i", asking[i], x[j])  # summed alike whatever else is in the block
                    order = np.lexsort((j, -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    own = np.arange(len(i)) - np.searchsorted(i, i) < few
                    i, j, exact = i[own], j[own], exact[own]
                    found = pa.RecordBatch.from_arrays([q.column("key").take(pa.array(i)), keys.take(pa.array(j)), pa.array(exact)], ["query", "key", "score"])
                    yield found.filter(pc.not_equal(found.column(0), found.column(1)))

    dealt = both.repartitionByRange(parts, "list", "segment").sortWithinPartitions("list", "segment", "asks")
    return dealt.mapInArrow(run, f"query {kind}, key {kind}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, most: int = QUERIES) -> DataFrame:
    """The ``k`` most similar vectors of each query by cosine, exactly; itself left out, ties go to the least key.

    Every query meets every vector: vectors are dealt into segments of about SEGMENT rows, at least one for each core, and the
    queries are sent to each. Nothing is broadcast; a task holds one segment and ``most`` queries, and k rows of a query leave it. Scores are
    sums in double precision, whose last bits may differ with the order of sums. Vectors have one length; those without a
    direction or with a null take no part.
    """
    own, asked = _unit(vectors, key, vector), _unit(queries, key, vector)
    segments = max(own.sparkSession.sparkContext.defaultParallelism, -(-own.count() // SEGMENT))
    rows = own.withColumns({"list": F.lit(0), "segment": F.pmod(F.xxhash64("key"), F.lit(segments)).cast("int")})
    every = asked.select(F.lit(0).alias("list"), F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.col("key").alias("query"), "unit")
    return _best(_meet(rows, every, k, 2 * segments, most), k).withColumnRenamed("key", key)


@dataclass
class Index:
    """Vectors in lists around centroids: ``rows`` (list, segment, key, unit), segments of each list, and lists to open."""

    centroids: np.ndarray
    segments: list[int]
    rows: DataFrame
    probes: int


def _fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of length 1 that each row of ``sample`` is near to one of; a list that runs empty starts anew at a row far from its own."""
    centroids = sample[:: max(1, len(sample) // lists)][:lists].copy()
    near, most = np.zeros(len(sample), np.int64), np.zeros(len(sample))
    for _ in range(FIT_ROUNDS):
        for p in range(0, len(sample), TILE):  # never all rows against all centroids
            score = sample[p : p + TILE] @ centroids.T
            near[p : p + TILE], most[p : p + TILE] = score.argmax(axis=1), score.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(most, kind="stable")[: len(empty)]]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centroids)
    return centroids


def _opened(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``queries`` (key, unit) once for each of the ``probes`` lists whose centroids are nearest."""
    kind = queries.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in range(0, b.num_rows, TILE):
                part = b.slice(p, TILE)
                lists = np.argsort(-(_matrix(part.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows)], ["list", "key", "unit"])

    return queries.mapInArrow(run, f"list int, key {kind}, unit array<double>")


def build_index(vectors: DataFrame, key: str, vector: str, path: str, *, recall: float = 0.95, k: int = 3) -> Index:
    """An index of every vector, written below ``path``: about the square root of their number of lists, MOST_LISTS at most.

    Centroids are fitted on the rows of least hash, FIT_ROWS for each list; all rows are then put into the list of the nearest
    centroid. Long lists are cut into segments of about SEGMENT rows, so a list of many equal vectors is no task's burden. How
    many lists a query opens is measured: the least number that holds ``recall`` of the ``k`` nearest, by the exact search, of up
    to PROBE_QUERIES vectors. Vectors without structure need many lists, those in groups a few.
    """
    spark = vectors.sparkSession
    own = _unit(vectors, key, vector)
    n = own.count()
    lists = max(1, min(MOST_LISTS, round(n**0.5)))
    order = [F.xxhash64("key"), "key"]
    sample = own.orderBy(*order).limit(lists * FIT_ROWS).select("unit").toPandas()["unit"]
    centroids = _fitted(np.stack(sample.to_list()), lists) if n else np.zeros((1, 1))
    _opened(own, centroids, 1).write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = {r.list: r["count"] for r in assigned.groupBy("list").count().collect()}
    segments = [max(1, -(-sizes.get(i, 0) // SEGMENT)) for i in range(len(centroids))]
    cut = F.pmod(F.xxhash64("key"), F.element_at(F.array(*[F.lit(s) for s in segments]), F.col("list") + 1))
    assigned.withColumn("segment", cut.cast("int")).repartitionByRange("list", "segment").sortWithinPartitions("list", "segment").write.parquet(f"{path}/rows")
    index = Index(centroids, segments, spark.read.parquet(f"{path}/rows"), 1)
    tried = spark.createDataFrame(own.orderBy(F.xxhash64(F.lit("probe"), "key"), "key").limit(PROBE_QUERIES).collect(), own.schema)
    wanted = nearest(tried, own, "key", "unit", k).select("query", "key")
    held = wanted.join(assigned.select("key", "list"), "key").collect()  # k rows for each query tried
    closest = {r.key: np.argsort(-(centroids @ np.array(r.unit)), kind="stable") for r in tried.collect()}
    ranks = sorted(int(np.flatnonzero(closest[r.query] == r.list)[0]) + 1 for r in held)
    if ranks:
        index.probes = ranks[min(len(ranks), int(np.ceil(recall * len(ranks)))) - 1]
    return index


def nearest_by_index(queries: DataFrame, index: Index, key: str, vector: str, k: int) -> DataFrame:
    """As ``nearest``, among the vectors of the lists that each query opens: those found have their exact scores and order, some may be missed.

    A query is sent to each segment of its lists and meets the rows there; lists that nobody opens are only read."""
    opened = _opened(_unit(queries, key, vector), index.centroids, index.probes)
    segments = F.element_at(F.array(*[F.lit(s) for s in index.segments]), F.col("list") + 1)
    asked = opened.select("list", F.explode(F.sequence(F.lit(0), segments - 1)).alias("segment"), F.col("key").alias("query"), "unit")
    return _best(_meet(index.rows, asked, k, 2 * min(sum(index.segments), 1024), QUERIES), k).withColumnRenamed("key", key)
