"""The index of stills: recall against the exact search, structure, copies, and the exact search itself."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vectors

SCHEMA = "id long, v array<double>, label string"


def pairs(df):
    return {(r.query, r.id) for r in df.collect()}


def grouped(n, groups, size, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size))
    return [(i, [float(x) for x in middles[i % groups] + 0.05 * rng.normal(size=size)], "x") for i in range(n)]


def plain(rows, asked, k):
    kept = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and None not in v and 0 < np.linalg.norm(v) < np.inf]
    out = {}
    for q, a in kept:
        if q in asked:
            score = [(-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), j) for j, b in kept if j != q]
            out[q] = [j for _, j in sorted(score)[:k]]
    return {(q, j) for q, js in out.items() for j in js}


def test_exact_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(150)] + [(900, [0.0] * 6, "x"), (901, None, "x"), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(vectors.nearest(df.where("id % 10 = 0"), df, "id", "v", 4, most=3)) == plain(rows, {i for i in range(0, 150, 10)}, 4)
    assert vectors.nearest(df.limit(0), df, "id", "v", 4).count() == 0 == vectors.nearest(df, df.limit(0), "id", "v", 4).count()


def test_ties_go_to_the_least_key(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], "copy") for i in (5, 3, 9, 1, 7)], SCHEMA)
    got = vectors.nearest(df.where("id = 3"), df, "id", "v", 3).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [(1, 1), (5, 2), (7, 3)]


def test_groups_need_few_lists(spark, tmp_path):
    df = spark.createDataFrame(grouped(2500, 40, 16, 3), SCHEMA)
    index = vectors.build_index(df, "id", "v", f"file://{tmp_path}/index")
    assert len(index.centroids) == 50 and index.probes <= 5
    assert index.rows.count() == 2500 and index.rows.select("key").distinct().count() == 2500
    asked = df.where("id % 100 = 0")
    exact, found = pairs(vectors.nearest(asked, df, "id", "v", 3)), pairs(vectors.nearest_by_index(asked, index, "id", "v", 3))
    assert len(exact & found) >= 0.9 * len(exact)
    index.probes = len(index.centroids)  # all lists: the exact way
    assert pairs(vectors.nearest_by_index(asked, index, "id", "v", 3)) == exact


def test_recall_without_structure(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = vectors.build_index(rows, "id", "embedding", f"file://{tmp_path}/index")
    asked = rows.where("id % 10 = 0")
    exact, found = pairs(vectors.nearest(asked, rows, "id", "embedding", 3)), pairs(vectors.nearest_by_index(asked, index, "id", "embedding", 3))
    assert len(exact & found) >= 0.9 * len(exact)


def test_a_list_of_copies_is_cut_into_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "SEGMENT", 50)
    df = spark.createDataFrame([(i, [1.0, 0.5, 0.0], "copy") for i in range(400)] + [(1000 + i, [float(i), 1.0, -2.0], "x") for i in range(40)], SCHEMA)
    index = vectors.build_index(df, "id", "v", f"file://{tmp_path}/index")
    parts = [r["count"] for r in index.rows.groupBy("list", "segment").count().collect()]
    assert max(index.segments) >= 8 and max(parts) < 100 and sum(parts) == 440
    got = vectors.nearest_by_index(df.where("id = 200"), index, "id", "v", 3).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2] and all(r.score == pytest.approx(1.0) for r in got)


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    index = vectors.build_index(df, "id", "v", f"file://{tmp_path}/index")
    assert vectors.nearest_by_index(spark.createDataFrame([(1, [1.0], "x")], SCHEMA), index, "id", "v", 3).count() == 0
    assert df.select(F.col("id")).count() == 0


def test_scores_are_held_in_blocks(monkeypatch):
    """A task holds one segment's scores of a block of queries, three times over, and a tile of rows against all centroids: bounded well below a worker's share."""
    assert 3 * 8 * vectors.SEGMENT * vectors.QUERIES <= 1 << 27
    assert 3 * 8 * vectors.TILE * vectors.MOST_LISTS <= 1 << 26
    sample = np.random.default_rng(3).normal(size=(2000, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    whole = vectors._fitted(sample, 20)
    monkeypatch.setattr(vectors, "TILE", 7)
    assert np.allclose(vectors._fitted(sample, 20), whole)
    tracemalloc.start()
    vectors._fitted(np.tile(sample, (10, 1)), 500)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000  # 80 MB of scores if all at once
    tracemalloc.stop()
