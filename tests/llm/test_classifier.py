"""Operator 11: features against plain Python, tables against a walk of them, held-out accuracy, and hard rows."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import text_features as tf
from tidemark.llm.additive_model import _best_grid, _shallow, featured, fit, learn, probability, score_quality
from tidemark.llm.queries import QUERIES

TEXTS = ["", " ", "a", "Ab cd", "ab ab ab\nab", "ÄÖ ü ## !! a#!\n\nx\n", "THE CAT sat. on,, the mat 12\r\n| x |", "  lead\ttail \n", "é" * 7, "a b a b a b", "\n", "x\n\nx\n\n"]
SPACES = " \t\n\x0b\x0c\r"


def plain(text: str) -> dict:
    kind = lambda c: tf.CLASS[c.encode()[0]]
    ws = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    mark = lambda c: tf.SYMBOL <= kind(c) <= tf.OTHER
    n, chars = max(len(ws), 1), max(sum(map(len, ws)), 1)
    lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
    share = lambda k: sum(kind(c) == k for c in text) / chars
    letters = max(sum(kind(c) in (tf.LOWER, tf.UPPER, tf.WIDE) for c in text), 1)
    length = sum(map(len, ws)) / n
    return {
        "log_words": np.log1p(len(ws)), "word_length": length, "length_spread": np.sqrt(max(sum(len(w) ** 2 for w in ws) / n - length**2, 0)),
        "upper": sum(kind(c) == tf.UPPER for c in text) / letters, "digits": share(tf.DIGIT), "symbols": share(tf.SYMBOL), "stress": share(tf.STRESS),
        "stops": share(tf.STOP), "other_marks": share(tf.OTHER), "wide": share(tf.WIDE), "doubled_marks": sum(a == b and mark(a) for a, b in zip(text, text[1:], strict=False)) / chars,
        "marked_words": sum(mark(w[-1]) and kind(w[-1]) != tf.STOP for w in ws) / n, "loud_words": sum(sum(kind(c) == tf.UPPER for c in w) >= 2 for w in ws) / n,
        "lone_marks": sum(all(map(mark, w)) for w in ws) / n, "words_a_line": np.log1p(len(ws) / max(len(lines), 1)), "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "same_as_before": sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, "distinct_words": len(set(ws)) / n, "distinct_pairs": len(set(zip(ws, ws[1:], strict=False))) / n,
    }


def test_features_match_plain_python(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for got, text in zip(tf.text_features(pa.array(texts)), texts, strict=True):
        assert dict(zip(tf.FEATURES, got, strict=True)) == pytest.approx(plain(text), abs=1e-9), text[:80]


def test_a_text_has_the_same_features_alone_and_among_others(monkeypatch):
    texts = [*TEXTS, None, "lorem ipsum\n" * 900]
    alone = np.concatenate([tf.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(tf.text_features(pa.array(texts)), alone)
    monkeypatch.setattr(tf, "PIECE", 1200)  # nine whole pieces: 12 bytes a line
    pieces = tf.text_features(pa.array(texts))
    assert np.array_equal(pieces[:-1], alone[:-1])
    kept = [i for i, f in enumerate(tf.FEATURES) if f not in ("same_as_before", "distinct_pairs")]
    assert np.allclose(pieces[-1][kept], alone[-1][kept])


def test_trees_cut_where_brute_force_does():
    rng = np.random.default_rng(3)
    for _ in range(30):
        g, h = rng.normal(size=(6, 5)), rng.uniform(2, 4, size=(6, 5))
        score = lambda parts: sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts)
        every = [0.0]
        for turned in (False, True):
            n, m = (5, 6) if turned else (6, 5)
            cell = (lambda r, c: np.ix_(c, r)) if turned else (lambda r, c: np.ix_(r, c))
            cuts = lambda r: [[cell(r, range(m))], *[[cell(r, range(c)), cell(r, range(c, m))] for c in range(1, m)]]  # noqa: B023, E731
            every += [score(a + b) - score([np.s_[:, :]]) for r in range(1, n) for a in cuts(range(r))[1:] for b in cuts(range(r, n))[1:]]
        gain, values = _best_grid(g, h)
        assert gain == pytest.approx(max(every))
        assert len(np.unique(values.round(12))) <= 4
        line, hess = g.sum(axis=1), h.sum(axis=1)
        assert len(np.unique(_shallow(line, hess).round(12))) <= 3


def test_the_model_adds_up_tables_and_finds_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = learn(x, y)
    assert (0, 1) in model.pairs
    assert ((probability(model.log_odds(x)) > 0.5) == (y == 1)).mean() > 0.93
    for row, total in zip(x[:40], model.log_odds(x[:40]), strict=True):
        own = model.intercept + sum(t[sum(v >= e for e in edges)] for t, edges, v in zip(model.tables, model.edges, row, strict=True))
        own += sum(t[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])] for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True))
        assert total == pytest.approx(own)


def test_held_out_documents_are_told_apart(spark):
    root = "/root/testdata/sf0.01"
    got = QUERIES["op11_quality_classifier"](spark, root)
    assert got.count() == spark.read.parquet(f"{root}/documents.parquet").count()
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_labels_that_are_held_out_do_not_enter(spark):
    root = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = flipped.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    a, b = fit(docs, seen), fit(docs, again)
    assert a.intercept == b.intercept and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_hard_rows(spark):
    schema = "`doc id` long, text string, x string, score double, lang string"
    docs = spark.createDataFrame([(1, None, "a", 1.0, None), (1, "", "b", 2.0, None), (None, "two words", None, None, "en"), (3, "w " * 200_000, "c", 0.0, None), (3, "w " * 200_000, "c", 0.0, None)], schema)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (3, None), (9, 7)], "`doc id` long, quality int")
    model = fit(docs, labels, key="doc id")
    got = score_quality(docs, model, key="doc id").collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score and got[3].score == got[4].score
    assert Counter(r["doc id"] for r in got) == {1: 2, None: 1, 3: 2}
    none = fit(docs.limit(0), labels, key="doc id")
    assert {r.score for r in score_quality(docs, none, key="doc id").collect()} == {0.5}
    assert score_quality(docs.limit(0), model, key="doc id").count() == 0
    assert featured(docs, ["doc id", "x"], "text").columns == ["doc id", "x", "x"]
