"""Streams with state, overlap by bins, sync that bears jitter, and change points: against brute force and planted cases."""

import random
import time
from datetime import datetime, timedelta
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes, intervals
from tidemark.plans import exchange, registry, timeline  # noqa: F401  the registry comes first
from tidemark.streaming import silences

BEGIN = datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def batch(points, gap):
    """(kind, island, t0, t1) of sorted seconds."""
    out, number, t0, last = [], 0, None, None
    for t in sorted(points):
        if last is None or t - last > gap:
            if last is not None:
                out += [("island", number, t0, last), ("silence", number + 1, last, t)]
                number += 1
            t0 = t
        last = t
    return out + [("island", number, t0, last)] if last is not None else out


class Streamed:
    """Runs of the stream over what has been added so far, each from the checkpoint of the one before."""

    def __init__(self, spark, path, gap, late, forget=None):
        self.spark, self.path, self.gap, self.late, self.forget = spark, f"file://{path}", gap, late, forget
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", silences.PROVIDER)

    def add(self, rows):
        frame = self.spark.createDataFrame([(k, at(s), "x") for k, s in rows], "user long, ts timestamp, kind string")
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/events")
        time.sleep(0.01)
        stream = self.spark.readStream.schema(frame.schema).parquet(f"{self.path}/events")
        told = silences.silence_stream(stream, ["user"], "ts", self.gap, f"{self.late} seconds", self.forget)
        run = told.writeStream.format("parquet").option("path", f"{self.path}/rows").option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
        self.state = run.lastProgress["stateOperators"][0]["numRowsTotal"]
        found = self.spark.read.schema(told.schema).parquet(f"{self.path}/rows").collect()
        second = lambda t: round((t - BEGIN).total_seconds())
        return sorted((r.user, r.kind, r.island, second(r.t0), second(r.t1)) for r in found)


def test_stream_gives_the_batch_rows_whatever_the_order(spark, tmp_path):
    rng = random.Random(7)
    gap, late = 60, 300
    points = sorted((rng.randrange(4), rng.randrange(0, 9000)) for _ in range(220))
    points.sort(key=lambda p: p[1] + rng.randrange(late))  # out of order, within the watermark
    stream = Streamed(spark, tmp_path, gap, late)
    for part in (points[:80], points[80:150], points[150:]):
        told = stream.add(part)
    passed = max(t for _, t in points) - late
    every = [(k, *row) for k in range(4) for row in batch([t for u, t in points if u == k], gap)]
    assert told == sorted(r for r in every if (r[4] + gap < passed if r[1] == "island" else r[4] < passed))


def test_late_rows_restarts_and_state_that_ends(spark, tmp_path):
    stream = Streamed(spark, tmp_path, 10, 20, forget=200)
    stream.add([(1, 0), (1, 5), (2, 3), (2, 100), (9, 100)])
    told = stream.add([(1, 50), (2, 110), (9, 95), (9, 131)])  # 50 is behind the watermark, 80; 95 isn't
    assert (1, "island", 0, 0, 5) in told and not any(r[0] == 1 and r[3] == 50 for r in told)
    assert (2, "silence", 1, 3, 100) in told and (9, "island", 0, 95, 100) in told
    before = stream.state
    told = stream.add([(9, 1000)])
    assert stream.state < before  # keys 1 and 2 are forgotten
    assert (2, "island", 1, 100, 110) in told and len(told) == len(set(told))
    told = stream.add([(1, 1005), (9, 1200)])
    assert (1, "island", 0, 1005, 1005) in told  # a key that comes back begins anew


def test_state_is_kept_by_buckets_and_keys_in_one_stay_apart(spark, tmp_path):
    """310 keys in 8 buckets make 8 states with a timer each, so messages to Python don't grow with keys; keys of any type come back as they were."""
    rng, gap, late, nan = random.Random(9), 60, 300, float("nan")
    keys = [(None, None, None, None), ("null", None, None, nan), ("", 2**53, at(0.000001), nan), ("", 2**53 + 1, at(0.000001), nan), ("", 2**53, at(0.000002), nan), ('"\\\n\u00e9', -5, None, 0.1), ("{}", None, at(7), float("-inf"))]
    keys += [("k", i, None, i / 7) for i in range(303)]
    points = [(k, rng.randrange(3000)) for k in keys for _ in range(6)]
    rng.shuffle(points)
    path, schema = f"file://{tmp_path}", "name string, number long, seen timestamp, x double, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", silences.PROVIDER)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # a bucket comes in several frames
    try:
        for part in ([p for p in points if p[1] < 1500], [p for p in points if p[1] >= 1500], [(keys[0], 10_000)]):
            spark.createDataFrame([(*k, at(t)) for k, t in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/events")
            stream = spark.readStream.schema(schema).parquet(f"{path}/events")
            told = silences.silence_stream(stream, ["name", "number", "seen", "x"], "ts", gap, f"{late} seconds", buckets=8)
            run = told.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 8
    found = spark.read.schema(told.schema).parquet(f"{path}/rows").collect()
    wanted = [(*k, kind, n, at(t0), at(t1)) for k in keys for kind, n, t0, t1 in batch([t for j, t in points if j is k], gap)]
    assert sorted(map(repr, (tuple(r)[:8] for r in found))) == sorted(map(repr, wanted))
    assert sum(r.n_events for r in found if r.kind == "island") == len(points)


def test_state_tasks_follow_cores_and_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert [exchange._state_tasks(spark, n) for n in (0, 1000, 36_000_001, 10**10)] == [4, 4, 10, 200]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_points_grow_and_join_islands():
    rng = random.Random(2)
    for _ in range(50):
        points, spans = [rng.randrange(200) for _ in range(30)], []
        for p in points:
            silences.grown(spans, p, 4)
        assert [(s[0], s[1]) for s in spans] == [r[2:] for r in batch(points, 4) if r[0] == "island"] and sum(s[2] for s in spans) == 30


@pytest.mark.parametrize("reach,length", [(100, 5), (5000, 900), (10**6, 10**6), (200_000, 70_000)])
def test_least_over_matches_brute_force(spark, reach, length):
    rng = random.Random(reach)
    points = [(rng.randrange(3), rng.randrange(-reach, reach), i) for i in range(300)] + [(None, 5, 900), (1, None, 901), (7, 0, 902)]
    spans = [(rng.randrange(3), a, a + rng.randrange(-2, length), rng.choice([0.1, 0.2, 0.7, None])) for a in (rng.randrange(-reach, reach) for _ in range(120))] + [(1, None, 5, 0.1), (None, 0, 9, 0.1)]
    got = intervals.least_over(spark.createDataFrame(points, "k int, t long, n int"), spark.createDataFrame(spans, "k int, a long, b long, gain double"), ["k"], "t", "gain", "least", "a", "b")
    want = {n: min((g for j, a, b, g in spans if None not in (k, t, j, a, b, g) and j == k and a <= t < b), default=None) for k, t, n in points}
    assert {r.n: r.least for r in got.collect()} == want


def test_one_hot_key_is_shared_and_rows_stay_in_proportion(spark):
    n = 200_000
    points = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 7 % 500_009).alias("t"))
    spans = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 13 % 500_009).alias("t0"), (F.col("id") * 13 % 500_009 + 1 + F.col("id") % 4000).alias("t1"), (F.col("id") % 97 / 97.0).alias("gain"))
    began = time.time()
    got = intervals.gain_at(points, spans, ["k"], "t")
    assert got.count() == n and got.where("gain < 1").count() > n // 2
    assert time.time() - began < 120  # 4 x 10^10 pairs
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(shares) < n / 3


def test_gain_at_takes_timestamps(spark):
    points = spark.createDataFrame([(1, at(5)), (1, at(50))], "k int, t timestamp")
    spans = spark.createDataFrame([(1, at(0), at(10), 0.5)], "k int, t0 timestamp, t1 timestamp, gain double")
    assert sorted((r.t, r.gain) for r in intervals.gain_at(points, spans, ["k"], "t").collect()) == [(at(5), 0.5), (at(50), 1.0)]


def test_planted_shifts_are_found_through_jitter(spark):
    rng = random.Random(11)
    a, b, planted = [], [], {}
    for k in range(30):
        own = [rng.randrange(0, 40_000) for _ in range(90)]
        planted[k] = rng.randrange(-40, 41) * 25
        a += [(k, t) for t in own]
        b += [(k, t + planted[k] + rng.randrange(-9, 10)) for t in own if rng.random() < 0.8] + [(k, rng.randrange(0, 40_000)) for _ in range(25)]
    got = {r.k: r for r in intervals.correlated(spark.createDataFrame(a, "k int, t int"), spark.createDataFrame(b, "k int, t int"), ["k"], "t", 25, 60).collect()}
    assert all(abs(got[k].offset - planted[k]) <= 25 for k in planted)
    assert all(0 < r.likeness <= 1 and 0.2 < r.margin <= 1 for r in got.values())


def test_correlation_matches_brute_force(spark):
    rng = random.Random(3)
    a, b = ([(k, rng.randrange(-300, 300)) for k in range(3) for _ in range(40)] for _ in range(2))
    a, b = a + [(8, 0)], b + [(9, 0), (1, None)]
    got = {r.k: r for r in intervals.correlated(spark.createDataFrame(a, "k int, t int"), spark.createDataFrame(b, "k int, t int"), ["k"], "t", 10, 12).collect()}

    def signal(side, k):
        s = np.zeros(200)
        for j, t in side:
            if j == k and t is not None:
                s[t // 10 + 99 : t // 10 + 102] += (1, 2, 1)
        return s

    assert set(got) == {0, 1, 2}
    for k, r in got.items():
        x, y = signal(a, k), signal(b, k)
        c = {d: sum(x[i] * y[i + d] for i in range(20, 180)) for d in range(-12, 13)}
        best = min(c, key=lambda d: (-c[d], abs(d), d))
        other = max(v for d, v in c.items() if abs(d - best) > 2)
        assert (r.offset, r.likeness, r.margin) == (best * 10, pytest.approx(c[best] / np.sqrt((x @ x) * (y @ y))), pytest.approx(1 - other / c[best]))


def cheapest(x, penalty):
    """The least cost over all segmentations."""
    n, best = len(x), None
    for cut in range(1 << max(n - 1, 0)):
        edges = [0, *[i + 1 for i in range(n - 1) if cut >> i & 1], n]
        cost = sum(((x[a:z] - x[a:z].mean()) ** 2).sum() + penalty for a, z in zip(edges, edges[1:], strict=False))
        best = min((cost, edges[:-1]), best or (cost, edges[:-1]), key=lambda c: (round(c[0], 9), c[1]))
    return best


def test_segments_cost_least_of_all():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 8, 10, 11]:
        for penalty in (0.0, 0.3, 2.0, 50.0):
            x = rng.normal(size=n) + 3 * (np.arange(n) > n // 2)
            cost, _ = cheapest(x, penalty)
            found = [*changes.segmented(x, penalty), n]
            assert found[0] == 0
            assert sum(((x[a:z] - x[a:z].mean()) ** 2).sum() + penalty for a, z in zip(found, found[1:], strict=False)) == pytest.approx(cost)
    level = np.repeat(rng.permutation(40) * 10.0, 500)
    began = time.time()
    assert changes.segmented(level + rng.normal(size=20_000), 60.0) == [i for i in range(0, 20_000, 500)]
    assert time.time() - began < 20


def test_change_points_and_turns_of_keys(spark):
    rows = [(1, t, float(t >= 6) * 9 + t % 2, "c") for t in range(12)] + [(2, 5, 1.0, "c"), (3, 1, None, "c"), (None, 1, 2.0, "c"), (4, 1, 2.0, "c"), (4, 1, 4.0, "c"), (4, 2, 3.0, "c")]
    series = spark.createDataFrame(rows, "k int, t int, x double, mean string")
    got = sorted(map(tuple, changes.change_points(series, ["k"], "t", "x", 10.0).collect()))
    assert got == [(1, 0, 0, 5, 6, 0.5), (1, 1, 6, 11, 6, 9.5), (2, 0, 5, 5, 1, 1.0), (4, 0, 1, 2, 2, 3.0)]
    assert sorted((r.k, r.turn) for r in changes.turn(series, ["k"], "t", "x").collect()) == [(1, 6), (4, 2)]
    assert changes.change_points(series.limit(0), ["k"], "t", "x", 1.0).count() == 0


def test_equal_costs_come_out_as_plain_sums_have_them():
    """A value midway between two levels costs the same on either side, so rounding decides: as in the SQL, from running sums of the values themselves."""
    rng, differ = np.random.default_rng(5), 0
    for _ in range(300):
        a, step = round(rng.uniform(20, 60), 3), round(rng.uniform(25, 35), 3)
        x = [round(v, 3) for v in (a, a, a + step, a + 2 * step, a + 2 * step)]
        n, cost, last = len(x), [-800.0], []
        s, q = [list(accumulate(y, initial=0.0)) for y in (x, [v * v for v in x])]  # sum() would make up for lost bits
        for t in range(1, n + 1):
            whole = [cost[i] + q[t] - q[i] - (s[t] - s[i]) ** 2 / (t - i) for i in range(t)]
            cost.append(min(whole) + 800.0)
            last.append(whole.index(min(whole)))
        wanted = [last[-1]]
        while wanted[0]:
            wanted.insert(0, last[wanted[0] - 1])
        assert changes.segmented(np.array(x), 800.0, centred=False) == wanted
        differ += changes.segmented(np.array(x), 800.0) != wanted
    assert differ


def test_a_days_level_does_not_depend_on_files(spark, tmp_path):
    """(46.82 + 59.78 + 38.04 + 22.35) / 4 lies halfway between thousandths: added in order of events it falls below, and must, however the files are cut."""
    values = {1: 46.82, 2: 59.78, 3: 38.04, 4: 22.35, 5: None}
    for folder, files in (("a", [[1, 2, 3, 4, 5]]), ("b", [[3, 4], [5], [1, 2]]), ("c", [[4, 3, 2, 1, 5]])):
        for ids in files:
            rows = spark.createDataFrame([(i, 7, "view", values[i], "x") for i in ids], "event_id long, user_id long, event_type string, value double, props string")
            rows.coalesce(1).withColumn("ts", F.lit("2024-01-02").cast("timestamp_ntz")).write.mode("append").parquet(f"{tmp_path}/{folder}/events.parquet")
        assert [tuple(r) for r in timeline._days(spark, f"{tmp_path}/{folder}").collect()] == [(7, 19724, 41.747)]
