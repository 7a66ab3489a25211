"""Phrases, punch words, definition cards, fillers by context and checked hits, against brute force and hard rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import wording
from tidemark.plans.wording import CARD, DEFINES

DOC = "id long, said string"


def brute_terms(docs, least, lift):
    n, where, per = Counter(), defaultdict(set), Counter()
    for key, text in docs:
        for line in (text or "").split("\n"):
            ts = re.findall(r"[^\W_]+", line.lower())
            for term in ts + [f"{a} {b}" for a, b in zip(ts, ts[1:])]:
                n[term] += 1
                where[term].add(key)
                per[key, term] += 1
    total = sum(c for t, c in n.items() if " " not in t)
    out = {}
    for t, c in n.items():
        a, _, b = t.partition(" ")
        if not b:
            out[t] = (c, len(where[t]), None)
        elif c >= least and c * total / (n[a] * n[b]) >= lift:
            out[t] = (c, len(where[t]), c * total / (n[a] * n[b]))
    return out, per


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, "\n".join(" ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(40)], k=rng.randrange(0, 12))) for _ in range(3))) for i in range(60)]
    docs += [(i, "the deep river ran\nDeep River again") for i in (100, 101, 102)]
    return [*docs, (200, None), (201, ""), (202, " \n . \n"), (0, "w1 w1 again"), (203, "w0 " * 20000)]


def test_statistics_and_punch_words_match_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, DOC).withColumn("term", F.lit("x")).withColumn("n", F.lit(1))
    stats = wording.term_statistics(df, "id", "said", least=2, lift=3.0)
    want, per = brute_terms(corpus, 2, 3.0)
    got = {r.term: (r.n, r.n_docs, r.lift) for r in stats.collect()}
    assert got.keys() == want.keys() and "deep river" in got
    assert all(got[t][:2] == want[t][:2] and (got[t][2] is None) == (want[t][2] is None) and got[t][2] == pytest.approx(want[t][2]) for t in want)

    n_docs, common = len({k for k, _ in corpus}), 0.3
    best = defaultdict(list)
    for (key, t), c in per.items():
        if len(t) > 1 and t in want and want[t][1] <= common * n_docs:
            best[key].append((-round(1000 * c * math.log(n_docs / want[t][1])), -len(t), t, c))
    want_rows = {(k, i + 1, t, c, -s) for k, rows in best.items() for i, (s, _, t, c) in enumerate(sorted(rows)[:2])}
    assert {tuple(r) for r in wording.punch_words(df, stats, "id", "said", n_docs, k=2, common=common).collect()} == want_rows


def test_hot_words_meet_no_join(spark, corpus):
    df = spark.createDataFrame(corpus, DOC)
    stats = wording.term_statistics(df, "id", "said")
    assert not {r.term for r in wording.punch_words(df, stats, "id", "said", 60, k=99, common=0.1).collect()} & {"w0", "w1", "w2"}


def test_definition_cards(spark):
    said = [
        (1, "Osmosis is the passage of water. It is a thing we know! Why diffusion, who knows?\nHalf-life: the time that half takes"),
        (2, "It is what it is now"), (3, "It is all that there is"), (4, None), (5, ""), (6, "Osmosis is short"), (7, "It is again so said"), (7, "It is again so said"),
    ]
    df = spark.createDataFrame(said, DOC)
    got = wording.definition_cards(df, wording.term_statistics(df, "id", "said"), "id", "said", 7, DEFINES, common=0.3)
    assert {tuple(r) for r in got.collect()} == {(1, 0, "Osmosis", "the passage of water"), (1, 3, "Half-life", "the time that half takes")}


def test_fillers_by_context(spark):
    said = [
        (1, 0, "Um", 0, 1), (1, 1, "I", 2, 3), (1, 2, "i", 4, 5), (1, 3, "like", 6, 7), (1, 4, "it", 8, 9), (1, 5, "well", 20, 21), (1, 6, "we", 40, 41), (1, 7, "go", 42, 43),
        (1, 8, "we", 44, 45), (1, 9, "go", 46, 47), (1, 10, "go", 90, 91), (1, 11, None, 92, 93), (1, 12, None, 94, 95), (2, 0, "like", 0, 1),
    ]
    df = spark.createDataFrame(said, "k int, i int, word string, a long, b long").withColumn("extra", F.lit(1))
    got = wording.fillers_by_context(df, ["k"], ["i"], "word", "a", "b", ["um"], ["like", "well"], 10)
    assert got.columns == [*df.columns, "reason"]
    assert {(r.k, r.i, r.reason) for r in got.collect()} == {(1, 0, "sure"), (1, 1, "repeat"), (1, 5, "pause"), (1, 6, "repeat"), (1, 7, "repeat"), (2, 0, "pause")}


def test_checks_of_hits(spark):
    said = [(1, "4539 1488 0343 6467 and 4539148803436468"), (2, None), (3, ""), (4, "8.8.8.8 10.0.0.1 172.20.1.1 300.1.1.1 192.169.0.1"), (5, "k=aaaaaaaaaaaa1 k=zX9mQ2vL7p"), (6, "x45391488034364671")]
    rules = {
        "card": (CARD, lambda m: wording.luhn_valid(F.regexp_replace(m, "[^0-9]", ""))), "net": (r"((?:\d+\.){3}\d+)", wording.octets_valid), "key": (r"k=(\w+)", lambda m: wording.varied(m, 6)),
    }
    got = wording.hits(spark.createDataFrame(said, DOC), "said", rules).collect()
    assert {(r.id, r.n_card, r.n_net, r.n_key) for r in got} == {(1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 2, 0), (5, 0, 0, 1), (6, 0, 0, 0)}


def test_luhn_matches_the_rule(spark):
    rng = random.Random(2)
    numbers = ["".join(rng.choices("0123456789", k=rng.randrange(1, 20))) for _ in range(200)]
    right = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", wording.luhn_valid(F.col("n")).alias("ok")).collect()
    assert all(r.ok == right(r.n) for r in rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOC)
    stats = wording.term_statistics(df, "id", "said")
    assert stats.isEmpty() and wording.punch_words(df, stats, "id", "said", 0).isEmpty() and wording.definition_cards(df, stats, "id", "said", 0, DEFINES).isEmpty()

def test_runs_of_sorted_terms(spark):
    rows = [(1, ["b", "a", "b", "", "a b"]), (2, []), (3, ["z"] * 1000), (4, None)]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id long, t array<string>").select("id", wording._counts(F.col("t")).alias("c")).collect()}
    assert [tuple(x) for x in got[1]] == [("", 1), ("a", 1), ("a b", 1), ("b", 2)] and got[2] == [] and [tuple(x) for x in got[3]] == [("z", 1000)] and got[4] is None


def test_words_alone_are_the_words_of_all_terms(spark, corpus):
    df = spark.createDataFrame(corpus, DOC)
    all_ = {tuple(r) for r in wording.term_statistics(df, "id", "said").where("lift IS NULL").collect()}
    assert {tuple(r) for r in wording.term_statistics(df, "id", "said", phrases=False).collect()} == all_
    assert wording.term_statistics(df.limit(0), "id", "said", phrases=False).collect() == []


def test_terms_are_counted_in_parts_of_any_size(spark, monkeypatch):
    """Rows are counted where they are read, by parts of a task: parts don't matter, nor do lines, accents, empty and null texts or equal keys."""
    texts = ["One two one\ntwo ÉTÉ 12", "", None, "...", "one two, one two\r\nthree", "x" * 300 + " y", "one\n\ntwo", "y one two"]
    rows = [(i if i < 6 else 6, t) for i, t in enumerate(texts)]
    wanted = Counter()
    for i, t in rows:
        for line in (t or "").lower().split("\n"):
            w = [x for x in re.split(r"[^\w]+", line) if x]
            wanted.update((i, x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    df = spark.createDataFrame(rows, "id long, said string")
    assert {(r.id, r.term): r.n for r in wording._terms_of(df, "id", "said").collect()} == wanted
    got = {r.term: (r.n, r.n_docs) for r in wording._term_counts(df, "id", "said", True).collect()}
    assert got == {t: (sum(n for (_, u), n in wanted.items() if u == t), sum(u == t for _, u in wanted)) for _, t in wanted}
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "x" * 50, "", "c"])], ["__text"])
    monkeypatch.setattr(wording, "PART_BYTES", 3)
    assert [p.column(0).to_pylist() for p in wording._parts([batch])] == [["ab", None], ["x" * 50], ["", "c"]]
