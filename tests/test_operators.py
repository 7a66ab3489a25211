import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, selection, vectors
from tidemark.sources import diagnostics, xml
from tidemark.streaming.density import density

SPAN = "k int, t0 int, t1 int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def spans(n, seed, reach=200):
    rng = random.Random(seed)
    return [(rng.randrange(4), a, a + rng.randrange(1, 20)) for a in (rng.randrange(reach) for _ in range(n))]


def covered(ivs):
    out = {}
    for k, a, b in ivs:
        out.setdefault(k, set()).update(range(a, b))
    return out


def test_merge_and_complement_partition_the_whole(spark):
    data = spans(120, 1)
    merged = rows(intervals.merge(spark.createDataFrame(data, SPAN), ["k"]))
    assert covered(merged) == covered(data)
    assert all(x[2] < y[1] for x, y in zip(merged, merged[1:]) if x[0] == y[0])  # touching ones are one
    whole = spark.createDataFrame([(k, 0, 300) for k in range(5)], SPAN)
    rest = covered(rows(intervals.complement(spark.createDataFrame(data, SPAN), whole, ["k"])))
    kept = covered(data)
    for k in range(5):
        assert rest.get(k, set()) == set(range(300)) - kept.get(k, set())


def test_complement_of_what_sticks_out_of_the_whole(spark):
    got = rows(intervals.complement(spark.createDataFrame([(1, -5, 3), (1, 8, 30)], SPAN), spark.createDataFrame([(1, 0, 10)], SPAN), ["k"]))
    assert got == [(1, 3, 8)]


def test_intersect(spark):
    a, b = spans(60, 2), spans(60, 3)
    got = covered(rows(intervals.intersect(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"])))
    x, y = covered(a), covered(b)
    assert {k: v for k, v in got.items() if v} == {k: x[k] & y[k] for k in x if x[k] & y.get(k, set())}


def test_snap_takes_the_nearest_and_the_earlier_of_two(spark):
    points = spark.createDataFrame([(1, 5), (1, 0), (1, 100), (2, 7)], "k int, t int")
    edges = spark.createDataFrame([(1, 3), (1, 7), (1, 90)], "k int, e int")
    assert rows(intervals.snap(points, edges, ["k"], "t", "e").fillna(-1)) == [(1, 0, 3), (1, 5, 3), (1, 100, 90), (2, 7, -1)]


def test_offsets_find_a_planted_shift(spark):
    rng = random.Random(4)
    a = [(k, rng.randrange(100_000)) for k in range(3) for _ in range(60)]
    b = [(k, t + 10 * k + 17) for k, t in a] + [(k, rng.randrange(100_000)) for k in range(3) for _ in range(60)]
    got = {r.k: r.offset for r in intervals.offsets(spark.createDataFrame(a, "k int, t long"), spark.createDataFrame(b, "k int, t long"), ["k"], "t", 400).collect()}
    assert got == {0: 17, 1: 27, 2: 37}


def test_capped_prefix_stops_at_the_first_item_too_many(spark):
    items = spark.createDataFrame([(1, 1, 4.0), (1, 2, 4.0), (1, 3, 9.0), (1, 4, -5.0), (2, 1, 11.0), (3, 1, 10.0)], "k int, pos int, cost double")
    assert [r[:2] for r in rows(selection.capped(items, ["k"], ["pos"], "cost", 10.0).select("k", "pos"))] == [(1, 1), (1, 2), (3, 1)]


def test_best_per_with_ties_and_nulls(spark):
    takes = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (1, 3, None), (2, 1, None)], "line int, take int, score double")
    assert {r.line: r["take"] for r in selection.best_per(takes, ["line"], "score", "take").collect()} == {1: 1, 2: 1}


def test_packs_add_no_authority(spark):
    tools = spark.createDataFrame([("a", ["x"], []), ("b", ["x"], ["admin"]), ("c", ["y"], []), ("d", [], [])], "name string, packs array<string>, requires array<string>")
    assert rows(selection.exposed(tools, ["read"], ["x"]).select("name")) == [("a",)]


def test_a_failed_check_refuses_the_write(spark, tmp_path):
    good, bad = spark.range(3), spark.range(1)
    with pytest.raises(ValueError, match="refused"):
        diagnostics.write_checked(good, bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    diagnostics.write_checked(good, bad.where("id > 5"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_not_checked_is_neither_healthy_nor_failed(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"component":"a","status":"ok"}\n{"component":"b","status":"not_checked"}\n{"component":"c","status":"needs_attention"}\n')
    got = {r.component: r.healthy for r in diagnostics.read_diagnostics(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": None, "c": False}


def test_xml_round_trip(spark, tmp_path):
    clips = spark.createDataFrame([("a & b", 1, 2), ("<c>", 3, 9)], "name string, t0 long, t1 long")
    xml.write_rows(clips, str(tmp_path / "x"), "sequence", "clip")
    assert rows(xml.read_rows(spark, str(tmp_path / "x"), "clip", clips.schema)) == rows(clips)


def test_density_on_a_stream_equals_batch_up_to_the_watermark(spark, tmp_path):
    events = spark.range(200).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = density(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", late="10 minutes")
    q = stream.writeStream.format("memory").queryName("density_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = rows(density(events, "ts", "1 hour"))
    got = rows(spark.table("density_out"))
    assert got and set(got) <= set(batch) and len(got) >= len(batch) - 1


def test_nearest_asks_more_queries_than_a_block_holds(spark):
    rng = random.Random(8)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    table = spark.createDataFrame(vecs, "id long, v array<float>").cache()
    want = rows(vectors.nearest(table, table, "id", "v", 3))
    assert len(want) == 180
    for most in (59, 10):
        assert rows(vectors.nearest(table, table, "id", "v", 3, most=most)) == want


def brute_contained(a, k):
    return sorted(x for x in a if not any(y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in k))


def test_not_contained_and_intersect_against_brute_force(spark):
    a, k = spans(200, 5) + [(1, 5, 9), (1, 5, 9)], spans(60, 6) + [(1, 5, 9)]
    df, kept = spark.createDataFrame(a, SPAN), spark.createDataFrame(k, SPAN)
    assert rows(intervals.not_contained(df, kept, ["k"])) == brute_contained(a, k)
    nulls = spark.createDataFrame([(1, None, 3), (None, 1, 2), (1, 5, 6)], SPAN)
    got = intervals.not_contained(nulls, spark.createDataFrame([(1, 0, 9), (None, 0, 9), (1, None, 20)], SPAN), ["k"])
    assert {tuple(r) for r in got.collect()} == {(1, None, 3), (None, 1, 2)}
    assert intervals.intersect(df.limit(0), kept, ["k"]).count() == 0 and intervals.not_contained(df, kept.limit(0), ["k"]).count() == len(a)


def test_gain_keeps_repeated_points_and_any_column(spark):
    points = spark.createDataFrame([(1, 5, {"x": 1}), (1, 5, {"x": 1}), (1, 50, None), (None, 5, None), (2, None, None)], "k int, t int, m map<string,int>")
    beds = spark.createDataFrame([(1, 0, 10, 0.5), (1, 3, 6, 0.25), (2, 0, 10, 0.1)], "k int, t0 int, t1 int, gain double")
    got = intervals.gain_at(points, beds, ["k"], "t")
    assert got.columns == ["k", "t", "m", "gain"]
    assert sorted((str(r.k), str(r.t), r.gain) for r in got.collect()) == [("1", "5", 0.25), ("1", "5", 0.25), ("1", "50", 1.0), ("2", "None", 1.0), ("None", "5", 1.0)]


def test_snap_and_offsets_on_timestamps(spark):
    at = lambda name: F.timestamp_seconds(name).cast("timestamp_ntz")
    points = spark.createDataFrame([(1, 5), (1, 0), (2, 7)], "k int, s int").select("k", at("s").alias("t"))
    edges = spark.createDataFrame([(1, 3), (1, 7)], "k int, s int").select("k", at("s").alias("e"))
    assert [str(r.snapped)[-2:] for r in intervals.snap(points, edges, ["k"], "t", "e").orderBy("k", "t").collect()] == ["03", "03", "ne"]
    a = spark.createDataFrame([(1, s) for s in (10, 20, 45)], "k int, s int").select("k", at("s").alias("t"))
    b = spark.createDataFrame([(1, s + 4) for s in (10, 20, 45)], "k int, s int").select("k", at("s").alias("t"))
    assert intervals.offsets(a, b, ["k"], "t", 9_000_000).first()["offset"] == 4_000_000


def test_best_per_with_names_as_ties(spark):
    takes = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 4)], "line int, take string, score int")
    assert selection.best_per(takes, ["line"], "score", "take").first()["take"] == "a"


def test_listing_capabilities_and_spans_alone(spark):
    items = spark.createDataFrame([("a",), ("f/b",), ("f/g/c",), ("f",)], "p string").select("p", F.split("p", "/").alias("path"))
    assert rows(selection.children(items, "path").select("p")) == [("a",), ("f",)]
    assert rows(selection.children(items, "path", ["f"]).select("p")) == [("f/b",)]
    tools = spark.createDataFrame([("a", []), ("b", ["admin"]), ("c", None)], "name string, requires array<string>")
    assert rows(selection.capabilities(tools, "name", ["read"])) == [("a", True), ("b", False), ("c", False)]
    got = selection.checked_alone(spark.createDataFrame([(1, 2), (3, 3), (None, 4)], "t0 int, t1 int"), {"order": F.col("t0") < F.col("t1")})
    assert [r.failed for r in got.collect()] == [[], ["order"], ["order"]]


def test_a_bed_turns_on_its_line(spark):
    beds, lines = spark.createDataFrame([(1, 7), (2, 3)], "k int, turn int"), spark.createDataFrame([(1, 10)], "k int, t int")
    assert rows(intervals.turned(beds, lines, ["k"], "turn", "t").na.fill(-1)) == [(1, 7, 3), (2, 3, -1)]


def test_measures_are_weighed_by_their_ranges(spark):
    beds = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 0.0), (3, 10.0, None), (4, 10.0, 10.0)], "id int, a double, b double")
    got = selection.measured(beds, {"x": (F.col("a"), 1.0), "y": (F.col("b"), 0.5), "same": (F.lit(3), 9.0)}, "id", 3)
    assert [(r.id, r.score) for r in got.collect()] == [(4, 1.5), (3, 1.0), (1, 0.5)]
    assert selection.measured(beds.limit(0), {"x": (F.col("a"), 1.0)}, "id", 3).collect() == []
