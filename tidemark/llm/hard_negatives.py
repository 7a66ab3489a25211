"""Hard negatives: the most similar rows of other labels, by integer products taken bit by bit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.centroids import matrix, whole_numbers
from tidemark.llm.common import Scratch, frugal

#: Components of this size are refused: up to it sums of 64 products are exact in double precision.
LARGEST = 1 << 22
#: Rows of a strip, which one task holds as integers while anchors pass by.
STRIP = 1 << 18
#: Anchors and rows whose products are taken at once.
ANCHORS, TILE = 512, 1024
#: Pairs are followed one by one once fewer than this share of a tile is left; so many at a time.
SPARSE, PAIRS = 0.1, 1 << 15
NONE = np.iinfo(np.int64).max


def bit_planes(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(weight, rest, bits) of each plane of the two's complement of ``x``, most significant first: what a set bit counts, and
    what all planes after this one can add to a component at most."""
    n = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1).bit_length()
    yield -(1 << n), (1 << n) - 1, x < 0
    for j in range(n - 1, -1, -1):
        yield 1 << j, (1 << j) - 1, (x >> j) & 1 == 1


def survivors(x: np.ndarray, a: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of a, exact product) of the pairs that ``keep`` never drops.

    A product's interval after some planes is what they sum to, plus at most ``rest`` times the sum of the positive (negative)
    components of ``a``; each plane halves it. ``keep(low, high, j)`` says for intervals of the rows ``j`` of ``a`` (all of them,
    for whole tiles) which may still qualify. Planes of all pairs are matrix products of bits, exact as every sum is a whole
    number that the type holds; pairs that remain when few do are followed one by one.
    """
    up, down, size = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1), int(np.abs(a).sum(axis=1).max(initial=0))
    planes = list(bit_planes(x))
    kind = np.float32 if size * (planes[0][1] + 1) < 1 << 24 else np.float64
    at, total = a.T.astype(kind), np.zeros((len(x), len(a)), kind)
    i = j = np.zeros(0, np.int64)
    for k, (weight, rest, bits) in enumerate(planes):
        total += (bits.astype(kind) * kind(weight)) @ at
        if k + 1 < len(planes) and rest * size > 4 * (float(total.max(initial=0)) - float(total.min(initial=0))):
            continue  # intervals are so wide that none can be dropped
        alive = keep(total + (rest * down).astype(kind), total + (rest * up).astype(kind), slice(None))
        if np.count_nonzero(alive) <= SPARSE * alive.size or k + 1 == len(planes):
            i, j = np.nonzero(alive)
            break
    s = total[i, j].astype(np.int64)
    for weight, rest, bits in planes[k + 1 :]:
        for p in range(0, len(i), PAIRS):
            q = slice(p, p + PAIRS)
            s[q] += weight * np.einsum("ij,ij->i", bits[i[q]], a[j[q]])
        alive = keep(s + rest * down[j], s + rest * up[j], j)
        i, j, s = i[alive], j[alive], s[alive]
    return i, j, s


class Best:
    """The first ``k`` (score, key) of each of ``n`` lists: higher scores first, then the smaller key."""

    def __init__(self, n: int, k: int):
        self.score, self.key = np.full((n, k), -NONE), np.full((n, k), NONE)

    def add(self, at: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        """Offers scores to the lists ``at``; only those lists are written anew."""
        if not at.size:
            return
        k = self.score.shape[1]
        lists, at = np.unique(at, return_inverse=True)
        every = [np.concatenate(x) for x in ((np.repeat(np.arange(lists.size), k), at), (self.score[lists].ravel(), score), (self.key[lists].ravel(), key))]
        order = np.lexsort((every[2], -every[1], every[0]))
        own, score, key = (x[order] for x in every)
        rank = np.arange(own.size) - np.searchsorted(own, own)
        kept = rank < k
        self.score[lists], self.key[lists] = score[kept].reshape(-1, k), key[kept].reshape(-1, k)

    def last(self) -> np.ndarray:
        """The score of the last place of each list: what is lower can't enter."""
        return self.score[:, -1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.key != NONE)
        return at, self.score[at, place], self.key[at, place]


class Rows:
    """Rows of a strip, or anchors with their positives, as arrays."""

    def __init__(self, batches: list[pa.RecordBatch], anchors: bool = False):
        get = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        self.row, self.key, self.label = get("row"), get("key"), get("label")
        size = batches[0].column("size")[0].as_py()
        self.x = np.concatenate([matrix(b.column("x"), size) for b in batches])
        self.positives = [v for b in batches for v in b.column("positives").to_pylist()] if anchors else []


def _positives(n: int) -> Callable[[Rows, Rows], pa.RecordBatch]:
    def run(strip: Rows, anchors: Rows) -> pa.RecordBatch:
        best = Best(len(anchors.row), n)
        for label in np.unique(anchors.label):
            own, pool = np.flatnonzero(anchors.label == label), np.flatnonzero(strip.label == label)
            for p in range(0, len(pool), TILE):
                rows = pool[p : p + TILE]

                def keep(low, high, j, own=own, rows=rows):
                    least = best.last()[own].astype(np.float64)
                    if isinstance(j, slice) and len(rows) > n + 1:  # of n + 1 rows with such a low end n at least aren't the anchor itself
                        least = np.maximum(least, np.partition(low, len(rows) - n - 1, axis=0)[len(rows) - n - 1])
                    return high >= least[j]

                i, j, s = survivors(strip.x[rows], anchors.x[own], keep)
                other = strip.row[rows[i]] != anchors.row[own[j]]
                best.add(own[j[other]], s[other], strip.key[rows[i[other]]])
        at, score, key = best.found()
        return pa.RecordBatch.from_arrays([pa.array(anchors.row[at]), pa.array(anchors.key[at]), pa.array(key), pa.array(score)], ["row", "anchor", "positive", "score"])

    return run


def _negatives(n: int, n_positives: int, low_pct: int, high_pct: int) -> Callable[[Rows, Rows], pa.RecordBatch]:
    def run(strip: Rows, anchors: Rows) -> pa.RecordBatch:
        m = len(anchors.row)
        best = Best(m * n_positives, n)
        # the band of each positive: low_pct * p <= 100 * s <= high_pct * p; an empty one where there is none
        first, end = np.full((m, n_positives), NONE >> 1), np.full((m, n_positives), -(NONE >> 1))
        positive = np.zeros((m, n_positives), np.int64)
        score = np.zeros((m, n_positives), np.int64)
        for j, band in enumerate(anchors.positives):
            for k, p in enumerate(band):
                positive[j, k], score[j, k] = p["positive"], p["score"]
                first[j, k], end[j, k] = -(-low_pct * p["score"] // 100), high_pct * p["score"] // 100
        open_ = first <= end
        furthest = np.where(open_, end, -(NONE >> 1)).max(axis=1).astype(np.float64)

        def keep(low, high, j):
            last = best.last().reshape(m, n_positives)
            least = np.where(open_, np.maximum(first, last), NONE >> 1).min(axis=1).astype(np.float64)
            return (high >= least[j]) & (low <= furthest[j])

        for p in range(0, len(strip.row), TILE):
            rows = slice(p, p + TILE)
            i, j, s = survivors(strip.x[rows], anchors.x, keep)
            other = strip.label[rows][i] != anchors.label[j]
            i, j, s = i[other], j[other], s[other]
            inside, band = np.nonzero((first[j] <= s[:, None]) & (s[:, None] <= end[j]))
            best.add(j[inside] * n_positives + band, s[inside], strip.key[rows][i[inside]])
        at, s, key = best.found()
        j, k = at // n_positives, at % n_positives
        columns = [anchors.row[j], k, anchors.key[j], positive[j, k], score[j, k], key, s]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "place", "anchor", "positive", "positive_score", "negative", "negative_score"])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, strips: int, score: Callable[[Rows, Rows], pa.RecordBatch], schema: str) -> DataFrame:
    """``score(strip, anchors)`` for each strip of ``rows`` and all ``anchors`` of the same size, in blocks of ANCHORS.

    Anchors go to every strip; a task holds one strip, then takes the anchors that follow it block by block."""
    named = ["size", "strip", "kind", "row", "key", "label", "x", "positives"]
    own = rows.withColumns({"strip": F.pmod("row", F.lit(strips)).cast("int"), "kind": F.lit(0), "positives": F.lit(None).cast(anchors.schema["positives"].dataType)})
    every = anchors.withColumns({"strip": F.explode(F.sequence(F.lit(0), F.lit(strips - 1))), "kind": F.lit(1)})
    both = own.select(*named).unionByName(every.select(*named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        at, strip, n = None, None, 0

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal strip, waiting, n, held
            if waiting and (held or strip is not None):
                strip, held = strip or Rows(held), []
                yield score(strip, Rows(waiting, anchors=True))
            waiting, n = [], 0

        for b in batches:
            size, part, kind = (b.column(c).to_numpy() for c in ("size", "strip", "kind"))
            edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if a == z:
                    continue
                if (size[a], part[a]) != at:
                    yield from scored()
                    at, strip, held = (size[a], part[a]), None, []
                if kind[a] == 0:
                    held.append(b.slice(a, z - a))
                    continue
                for p in range(a, z, ANCHORS):
                    block = b.slice(p, min(ANCHORS, z - p))
                    if n + block.num_rows > ANCHORS:
                        yield from scored()
                    waiting.append(block)
                    n += block.num_rows
        yield from scored()

    # ranges rather than hashes: a strip for a task, and more ranges than strips, so that no two share one
    return both.repartitionByRange(4 * strips, "size", "strip").sortWithinPartitions("size", "strip", "kind", "row").mapInArrow(frugal(run), schema)


def _first(rows: DataFrame, by: list[str], score: str, key: str, n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1; the engine drops others before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def mine_negatives(
    rows: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """For each row that ``anchors`` holds for and each of its positives, the first ``negatives`` rows of other labels in its band.

    A row's score is its integer product with the anchor, components as floor(scale * x); higher scores come first, ties by
    the smaller key. Positives are the anchor's first ``positives`` other rows of its label; a negative's score s lies in
    low * p <= 100 * s <= high * p for the positive's score p. Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score`` and ``negative_score``.

    Rows whose key, label or vector is null or whose vector holds a null or a component that isn't finite take no part; key
    and label are whole numbers. Vectors meet those of their own length. Repeated rows are rows of their own: a copy of the
    anchor is its positive. An anchor without positives, or a positive without negatives, has no rows; an empty table gives
    none. Other columns can have any name. Scores are exact, or refused (LARGEST).

    Strips of at most about STRIP rows, dealt by number, so labels and copies of any frequency are spread evenly; anchors are
    sent to every strip, twice: for positives, then with the bands of these. Of each strip only an anchor's first few leave.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    named = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = whole_numbers(named.where("key IS NOT NULL AND label IS NOT NULL"), "x", scale, LARGEST)
    own = scratch.keep("rows", whole.withColumn("size", F.size("x")).withColumn("row", F.monotonically_increasing_id()))
    strips = max(2 * spark.sparkContext.defaultParallelism, -(-own.count() // STRIP))
    asked = own.where("anchor").drop("anchor")
    own = own.drop("anchor")
    none = F.lit(None).cast("array<struct<positive:bigint,score:bigint>>").alias("positives")
    met = _meet(own, asked.select("*", none), strips, _positives(positives), "row long, anchor long, positive long, score long")
    firsts = _first(met, ["row"], "score", "positive", positives, "rank").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive", "score"))).alias("positives"))
    firsts = scratch.keep("positives", firsts.select("row", F.transform("positives", lambda p: F.struct(p["positive"].alias("positive"), p["score"].alias("score"))).alias("positives")))
    met = _meet(own, asked.join(firsts, "row"), strips, _negatives(negatives, positives, low, high), "row long, place long, anchor long, positive long, positive_score long, negative long, negative_score long")
    out = _first(met, ["row", "place"], "negative_score", "negative", negatives, "rank")
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")
