import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import Scratch
from tidemark.llm.line_dedup import dedup_lines

ROOT = "/root/testdata/sf0.001"


def passage(seed, n):
    rng = random.Random(seed)
    return [f"passage {seed} line {i} " + " ".join(rng.choice("abcdef") * 3 for _ in range(8)) for i in range(n)]


@pytest.mark.parametrize("bits", [1 << 27, 32])
def test_repeats_go_and_one_of_each_line_stays(spark, monkeypatch, bits):
    """Also with a filter that is full, as it is where far more documents are listed than it has bits."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rng = random.Random(1)
    shared = [passage(i, 24) for i in range(5)]
    docs = []
    for i in range(60):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(2, 9))]
        docs.append((i, "\n".join(own[: len(own) // 2] + shared[i % 5] + own[len(own) // 2 :])))
    docs += [(100, "\n".join(shared[0])), (101, "one line only"), (102, "one line only"), (103, "w " * 60), (104, "w " * 60), (105, None), (106, ""), (107, "same\n" * 40), (None, "\n".join(shared[1])), (108, "twice\nthe row"), (108, "twice\nthe row")]
    table = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, start int, n_lines_removed string")
    rows = dedup_lines(table).collect()
    assert len(rows) == len(docs)
    old, new = {}, {}
    for k, t in docs:
        old[k] = t
    for r in rows:
        new[r.doc_id] = r.text
    first = {line for line in "\n".join(t for t in old.values() if t).split("\n")}
    assert {line for line in "\n".join(t for t in new.values() if t).split("\n")} - {""} == first - {""}  # every distinct line stays somewhere
    for r in rows:
        if r.text is not None:
            kept = iter(old[r.doc_id].split("\n"))
            assert all(line in kept for line in r.text.split("\n")) or r.text == ""  # in order
    for i in range(5, 60):
        left = [line for line in new[i].split("\n") if line.startswith("passage")]
        assert len(left) <= 8 and all(f"own {i} " in line for line in new[i].split("\n") if line not in left)
        assert new[i].count("own") == old[i].count("own")  # a document's own lines stay
    assert new[101] == new[102] == "one line only" and {new[103], new[104]} == {"w " * 60, ""}
    assert new[105] is None and new[106] == "" and new[108] == "twice\nthe row"
    assert dedup_lines(table.limit(0)).collect() == []
    gone = {r.doc_id for r in rows} - {r.doc_id for r in dedup_lines(table, drop_emptied=True).collect()}
    assert gone and all(not new[k].strip() and old[k].strip() for k in gone)


def test_shifted_passages_are_cut_alike(spark):
    p = passage(9, 60)
    for shift in range(5):
        docs = [(1, "\n".join(p)), (2, "\n".join([f"x{i}" for i in range(shift)] + p))]
        (r,) = (r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.doc_id == 2)
        assert r.n_lines_removed >= 50


def test_repeated_runs_of_two_to_six_lines_go_whole(spark):
    rng = random.Random(5)
    line = lambda i, n: f"r{i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(n - 1))
    runs = [[line(i, rng.randrange(90 // n // 2 + 3, 49) if n > 2 else rng.randrange(26, 49)) for _ in range(n)] for i, n in enumerate(n for n in range(2, 7) for _ in range(8))]
    runs = [r for r in runs if sum(len(x.split()) for x in r) >= 50]
    runs += [[r[0], "", *r[1:]] for r in ([line(900 + i, 30) for _ in range(3)] for i in range(4))]
    runs += [["one", "two", "three"] + [line(950, 20)] * 1 + [line(951, 27), "four"], [f"single{i}" for i in range(60)], ["tail of long", line(952, 60), "x y"]]
    docs = []
    for i, r in enumerate(runs):
        docs.append((i, "\n".join([f"before {i}", *r, f"after {i}"])))
        docs.append((1000 + i, "\n".join([f"own a {i}", f"own b {i}", *r, f"own c {i}"])))
        docs.append((2000 + i, "\n".join(r)))
    docs += [(3000, "few\nwords"), (3001, "few\nwords again"), (3003, "alone " * 49)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    old = dict(docs)
    for i in range(len(runs)):
        assert got[i] == old[i]
        assert got[1000 + i].split("\n") == [f"own a {i}", f"own b {i}", f"own c {i}"]
        assert got[2000 + i] == ""
    assert all(got[k] == old[k] for k in (3000, 3001, 3003))


def test_pipeline_stages_take_effect(spark):
    from test_jaccard import brute, shingles
    from test_lm_and_leaks import leaks
    from test_tokens_and_packing import check_packing

    docs, scratch, seen = spark.read.parquet(f"{ROOT}/documents.parquet"), Scratch(spark, "test"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.keep(name, stage(spark, docs, ROOT))
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id for r in seen[name][1]} <= {r.doc_id for r in seen[name][0]}
        else:
            pad, total = check_packing(seen[name][1], before)
            assert pad < 2048 + 0.01 * total
    before, after = seen["quality_rules"]
    assert 0.7 < len(after) / len(before) < 1
    before, after = seen["line_dedup"]
    assert sum(len(r.text) for r in after) < sum(len(r.text) for r in before) and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["jaccard_join"]
    roots = {k: c for k, _, c in brute([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == {k for k, c in roots.items() if k == c}
    assert shingles("a b c d e f") == {(b"a", b"b", b"c", b"d", b"e"), (b"b", b"c", b"d", b"e", b"f")}
    before, after = seen["decontamination"]
    bad = {k for k, *_ in leaks([(r.doc_id, r.text) for r in before], [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()])}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    assert len({(r.doc_id, r.start) for r in corpus_pipeline.run(spark, ROOT).collect()}) == len(seen["packing"][1])


def test_every_stage_on_hard_rows_and_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40)
    hard = [(9001, None, "en", "s", 0), (9002, "", "en", None, 0), (None, "no id here " * 5, None, None, 55), (9003, "same row " * 30, "en", "s", 270), (9003, "same row " * 30, "en", "s", 270), (9004, "x" * 200_000, "en", "s", 200_000)]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema)).withColumn("n_chars", F.col("n_chars").cast("long"))
    scratch = Scratch(spark, "hard")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.keep(name, stage(spark, docs, ROOT))
        empty = scratch.keep(f"{name}_empty", stage(spark, docs.limit(0), ROOT))
        assert empty.count() == 0 and empty.columns == out.columns
        ids = [r.doc_id for r in out.collect()]
        if name == "quality_rules":
            assert not {9001, 9002} & set(ids)
        elif name != "packing":
            assert {9001, 9002, None} <= set(ids) and ids.count(9003) in (0, 2)
        else:
            assert {9001, 9002, None, 9004} <= set(ids)


def test_the_filter_finds_all_that_is_listed(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("text"))
    listed = rows.where("id % 7 = 0").select(F.col("h").alias("g"))
    may, rest = common.split_listed(rows, F.col("h"), listed, "g")
    a, b = {r.id for r in may.collect()}, {r.id for r in rest.collect()}
    assert a >= {i for i in range(5000) if i % 7 == 0} and len(a) < 730 and a | b == set(range(5000)) and not a & b
    assert may.columns == rest.columns == rows.columns
    none = common.split_listed(rows, F.col("h"), listed.limit(0), "g")
    assert none[0].count() == 0 and none[1].count() == 5000
