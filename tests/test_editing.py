"""Lines taken again, caps by value, trees and sketches, against brute force and hard rows."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import caps, lines, selection, sketches, trees


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_planted_restarts_are_found_and_others_left_alone(spark):
    said = [
        (1, 0, "So we begin the story here"), (1, 1, "So we, um, begin a story here and then go on"), (1, 2, "Another thing entirely is this"), (1, 3, "we come back to it"),
        (1, 4, None), (1, 5, ""), (1, 6, "we come right back to it"), (1, 7, "yes"), (1, 8, "yes"), (2, 0, "we come back to it"),
    ]
    df = spark.createDataFrame(said, "k int, n int, line string").withColumn("shared", F.lit("x"))
    got = lines.retaken(df.drop("shared"), ["k"], "n", "line", ["um", "so", "the", "a"])
    assert sorted((r.k, r.n, r.again, r.shared, r.distance) for r in got.collect()) == [(1, 0, 1, 4, 0), (1, 3, 6, 2, 1)]
    loose = lines.retaken(df.drop("shared"), ["k"], "n", "line", ["um", "so"], head=4, edits=1)
    assert {(r.k, r.n, r.again, r.distance) for r in loose.collect()} == {(1, 0, 1, 1), (1, 3, 6, 1)}


def test_retaken_matches_brute_force(spark):
    rng = random.Random(5)
    said = [(k, n, " ".join(rng.choice("abcdu") for _ in range(rng.randrange(0, 9)))) for k in range(6) for n in range(40)]
    got = lines.retaken(spark.createDataFrame(said, "k int, n int, line string"), ["k"], "n", "line", ["u"], within=4, head=5, least=3, edits=2)
    want = set()
    for k in range(6):
        own = [[t for t in line.split() if t != "u"] for j, _, line in said if j == k]
        for n, a in enumerate(own):
            a = a[:5]
            for m in range(n + 1, min(n + 5, len(own))):
                b = own[m][:7]
                far = min(edit(a, b[: max(len(a) + e, 0)]) for e in (-2, -1, 0, 1, 2))
                if len(a) >= 3 and far <= 2:
                    want.add((k, n, m, next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))), far))
                    break
    assert {(r.k, r.n, r.again, r.shared, r.distance) for r in got.collect()} == want


def test_chosen_items_are_worth_most():
    rng = np.random.default_rng(2)
    for n in range(1, 11):
        for cap in (0, 3, 9, 30):
            t0 = np.sort(rng.integers(0, 25, n))
            t1 = t0 + rng.integers(0, 8, n)
            order = np.argsort(t1, kind="stable")
            t0, t1, cost, value = t0[order], t1[order], rng.integers(0, 7, n), rng.integers(0, 9, n)

            def fits(s, t0=t0, t1=t1, cost=cost, cap=cap):
                return cost[list(s)].sum() <= cap and all(t1[i] <= t0[j] for i, j in zip(s, s[1:], strict=False))

            best = max(value[list(s)].sum() for r in range(n + 1) for s in combinations(range(n), r) if fits(s))
            found = caps.chosen(t0, t1, cost, value, cap)
            assert fits(list(found)) and value[found].sum() == best


def test_capped_by_value_is_never_over_the_cap_nor_worse_than_the_prefix(spark):
    rng = random.Random(9)
    rows = [(k, n, rng.randrange(0, 40), rng.randrange(0, 12), "c") for k in range(8) for n in range(25)] + [(None, 1, 5, 1, "c"), (1, 90, None, 1, "c"), (1, 91, 3, -1, "c"), (9, 1, 5, 100, "c")]
    items = spark.createDataFrame(rows, "k int, n int, value int, cost int, total string")
    kept = caps.capped_by_value(items, ["k"], "n", "value", "cost", 50)
    assert kept.columns == items.columns
    got = {r.k: r for r in kept.groupBy("k").agg(F.sum("cost").alias("cost"), F.sum("value").alias("value")).collect()}
    prefix = {r.k: r.value for r in selection.capped(items.dropna().where("cost >= 0").drop("total"), ["k"], ["n"], "cost", 50).groupBy("k").agg(F.sum("value").alias("value")).collect()}
    assert set(got) == set(range(8)) and all(got[k].cost <= 50 and got[k].value >= prefix.get(k, 0) for k in got)
    with pytest.raises(ValueError, match="whole number"):
        caps.capped_by_value(items.withColumn("cost", F.lit(0.5)), ["k"], "n", "value", "cost", 50)


def test_descendants_of_a_forest_with_cycles(spark):
    rng = random.Random(1)
    edges = [(n, rng.randrange(n)) for n in range(1, 60)] + [(0, 7), (100, 101), (101, 100), (70, None), (5, 3), (5, 3)]
    items = spark.createDataFrame([(a, b, f"n{a}") for a, b in edges], "id int, parent int, name string")
    got = trees.descendants(items, "id", "parent", "name", spark.createDataFrame([(0,), (100,), (999,)], "id int"))
    want, front = {}, [((0,), 0), ((100,), 100)]
    for start in (0, 100):
        front, seen, depth = {start: ()}, {start}, 0
        while front:
            depth += 1
            below = {}
            for a, b in edges:
                if b in front and a not in seen:
                    below[a] = min(below.get(a, ("~",)), (*front[b], f"n{a}"))
            seen |= set(below)
            want |= {(start, a): (depth, list(p)) for a, p in below.items()}
            front = below
    assert {(r.root, r.id): (r.depth, r.path) for r in got.collect()} == want
    assert trees.descendants(items.limit(0), "id", "parent", "name", items.select("id").limit(0)).count() == 0


def test_merged_sketches_stay_within_the_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 20_000).alias("user"), F.lit(1).alias("sketch_"))
    days = sketches.sketched(rows, ["day"], F.col("user"))
    got = sketches.merged(days.withColumn("half", F.col("day") % 2), ["half"]).join(rows.groupBy((F.col("day") % 2).alias("half")).agg(F.count_distinct("user").alias("n")), "half")
    out = got.select("estimate", "n", sketches.within_bound(F.col("estimate"), F.col("n")).alias("ok")).collect()
    assert len(out) == 2 and all(r.ok and r.n > 10_000 for r in out)
    assert all(not r.ok for r in got.select(sketches.within_bound(F.col("n") * 2, F.col("n")).alias("ok")).collect())


def test_retaken_lines_tells_most_apart_at_once(spark):
    """Lines whose first tokens have nothing in common aren't aligned; those with a token put in, left out or changed at the front still are."""
    said = ["one two three", "zero one two three", "two three four five", "xx three four five", "q r", "r q", "alpha beta", "gamma delta"]
    rows = spark.createDataFrame(list(enumerate(said)), "n long, said string").selectExpr("1 AS k", "n", "said")
    found = lines.retaken(rows, ["k"], "n", "said", ["um"])
    assert {(r.n, r.again, r.distance) for r in found.collect()} == {(0, 1, 1), (2, 3, 1), (4, 5, 1)}
    assert "arrays_overlap" in found._jdf.queryExecution().optimizedPlan().toString()
