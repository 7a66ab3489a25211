"""Operators 12 and 13 against brute force in plain integers, with screens that can't decide, ties, copies and hard rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.llm import centroids, hard_negatives
from tidemark.llm.centroids import cluster, nearest
from tidemark.llm.hard_negatives import Best, bit_planes, mine_negatives, survivors

HARD = [
    (None, None, None, "a"), (901, None, 1, "b"), (902, [1.0, None], 1, "c"), (903, [float("nan"), 1.0], 1, "d"), (904, [float("inf"), 0.0], 2, "e"), (905, [], 1, "f"), (906, [1.0, 2.0, 3.0], 1, "g"),
]
SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def whole(x, scale):
    return [math.floor(scale * float(v)) for v in x]


def plain_negatives(rows, every):
    kept = [(i, whole(v, 256), lab) for i, v, lab, _ in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a, lab) in enumerate(kept):
        if i % every:
            continue
        score = [(sum(x * y for x, y in zip(a, b, strict=True)), j, own == lab) for m, (j, b, own) in enumerate(kept) if m != n and len(b) == len(a)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in score if s[2]][:5]:
            out += [(i, j, r, k, p, s) for r, (s, k, _) in enumerate([s for s in score if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,n,size,spread", [(1, 300, 8, 1.0), (2, 400, 3, 0.02), (3, 250, 5, 40.0), (4, 120, 1, 0.5)])
def test_negatives_match_brute_force(spark, monkeypatch, seed, n, size, spread):
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0.1, spread, size)], int(min(rng.geometric(0.4), 4)), "x") for i in rng.permutation(n)]
    rows += [rows[5], rows[5], (7, rows[9][1], 1, "y"), *[(2000 + i, rows[0][1], 2, "copy") for i in range(30)], *HARD]
    got = mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)


def test_planes_add_up_and_intervals_hold_the_product():
    rng = np.random.default_rng(0)
    for low, high in ((-300, 300), (0, 1), (-1, 0), (0, 1 << 21), (-(1 << 21), 5)):
        x, a = rng.integers(low, high + 1, (40, 6)), rng.integers(low, high + 1, (7, 6))
        assert (sum(w * bits.astype(np.int64) for w, _, bits in bit_planes(x)) == x).all()
        exact = x @ a.T

        def keep(lo, hi, j, exact=exact):
            if isinstance(j, slice):
                assert (lo <= exact).all() and (exact <= hi).all()
            return hi >= np.median(exact)

        i, j, s = survivors(x, a, keep)
        assert (exact[i, j] == s).all() and {(p, q) for p, q in zip(*np.nonzero(exact >= np.median(exact)), strict=True)} <= set(zip(i, j, strict=True))


def test_best_keeps_the_first():
    rng = np.random.default_rng(1)
    best, every = Best(5, 3), []
    for _ in range(40):
        at, score, key = rng.integers(0, 5, 9), rng.integers(0, 6, 9), rng.integers(0, 1000, 9)
        best.add(at, score, key)
        every += zip(at, score, key, strict=True)
    for k in range(5):
        assert [(s, x) for s, x in zip(best.score[k], best.key[k], strict=True)] == sorted([(s, x) for a, s, x in every if a == k], key=lambda p: (-p[0], p[1]))[:3]


def test_negatives_of_empty_and_refused_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(PySparkException, match="reaches"):
        mine_negatives(spark.createDataFrame([(1, [1e30], 1, "x")], SCHEMA), F.col("vec_id") == 1).count()


def plain_clusters(rows, size, k, rounds, scale=64):
    kept = [(i, whole(v, scale)) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in first]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda c: (far(v, cs[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        mine = [[v for (_, v), a in zip(kept, at, strict=True) if a == c] for c in range(len(cs))]
        cs = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(mine, cs, strict=True)]
    placed = [(i, near(v), far(v, cs[near(v)])) for i, v in kept]
    total = [sum(d for _, c, d in placed if c == k) for k in range(len(cs))]
    return sorted(((i, c, d, total[c], sum(total), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in placed), key=str)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.03), (3, 1e5)])
def test_clusters_match_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(centroids, "TILE", 50)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, spread, 4)], 1, "x") for i in range(240)]
    rows += [(None, [0.5] * 4, 1, "n"), rows[3], rows[3], *[(1000 + i, [spread] * 4, 1, "copy") for i in range(90)], *HARD]
    got = cluster(spark.createDataFrame(rows, SCHEMA), size=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 4, 16, 3)


def test_fewer_vectors_than_centroids_empty_and_refused(spark):
    few = [(i, [float(i), 1.0], 1, "x") for i in range(5)] + HARD
    assert sorted(map(tuple, cluster(spark.createDataFrame(few, SCHEMA), size=2).collect()), key=str) == plain_clusters(few, 2, 16, 3)
    none = cluster(spark.createDataFrame(HARD, SCHEMA), size=64)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(PySparkException, match="reaches"):
        cluster(spark.createDataFrame([(1, [1e30], 1, "x")], SCHEMA), size=1).count()


@pytest.mark.parametrize("top", [3, 500, 1 << 20, (1 << 27) - 1])
def test_the_screen_never_decides_wrongly(top):
    rng = np.random.default_rng(top)
    x = rng.integers(-top, top + 1, (400, 64))
    cs = x[:16] // 2
    cs[3] = cs[9]  # equal centroids: the lower number
    cs[5] = cs[6] + (np.arange(64) == 0)  # and some that single precision can't tell apart
    cs = cs.astype(np.int64)
    wide = x.astype(object)
    exact = np.array([[int(((v - c.astype(object)) ** 2).sum()) for c in cs] for v in wide], dtype=object)
    assert (nearest(x, cs) == np.array([min(range(16), key=lambda c: (row[c], c)) for row in exact])).all()
