"""The language-model scores against plain dictionaries, and what they tell of held-out documents."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import lm_scoring as lm
from tidemark.llm import queries

SCHEMA = "doc_id long, text string"


def brute(texts, target):
    """(n_tokens, target loss, background loss) of each text, own counts taken off."""
    events = []
    for t in texts:
        ws = t.split() if t else []
        events.append(list(zip(["<s>", *ws], [*ws, "</s>"], strict=True)) if ws else [])
    words = len({w for e in events for _, w in e})
    pairs, own = ({m: Counter(x for e, t in zip(events, target, strict=True) if t or m for x in f(e)) for m in (0, 1)} for f in (lambda e: e, lambda e: [w for _, w in e]))
    totals = {m: sum(own[m].values()) for m in (0, 1)}
    out = []
    for e, t in zip(events, target, strict=True):
        if not e:
            out.append((0, None, None))
            continue
        losses = []
        mine, mine_w = Counter(e), Counter(w for _, w in e)
        for m in (0, 1):
            less = 1 if m or t else 0
            scale = totals[0] / totals[1] if m and totals[0] else 1.0
            left, loss = totals[m] - less * len(e), 0.0
            for v, w in e:
                c = own[m]["</s>" if v == "<s>" else v] - less * mine_w["</s>" if v == "<s>" else v]
                lam = lm.BIGRAM * scale * c / (scale * c + lm.CONTEXT)
                uni = (own[m][w] - less * mine_w[w]) / left if left else 0
                rest = (lm.UNIGRAM * uni + (lm.UNIFORM if left else lm.UNIFORM + lm.UNIGRAM) / words) / (lm.UNIGRAM + lm.UNIFORM)
                loss -= math.log(lam * (pairs[m][v, w] - less * mine[v, w]) / max(c, 1) + (1 - lam) * rest)
            losses.append(loss / len(e))
        out.append((len(e) - 1, *losses))
    return out


def held(spark, texts, target_ids):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    keys = spark.createDataFrame([(i,) for i in target_ids], "doc_id long")
    return {r.doc_id: r for r in lm.score_difference(docs, keys).collect()}


def agree(got, want):
    for i, (n, t, b) in enumerate(want):
        assert got[i].n_tokens == n
        if n == 0:
            assert got[i].target_loss is None and got[i].background_loss is None and got[i].score is None
        else:
            assert abs(got[i].target_loss - t) < 1e-9 and abs(got[i].background_loss - b) < 1e-9 and abs(got[i].score - (t - b)) < 1e-9


def test_equals_plain_dictionaries(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"Wörd{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(200)]
    texts += [None, "", " \n", "wörd1 WÖRD1 wörd1", texts[3], texts[3], "x" * 9000, "a b " * 9000]
    target = [i for i in range(len(texts)) if i % 3 == 0]
    want = brute([t and t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in texts], [i % 3 == 0 for i in range(len(texts))])
    agree(held(spark, texts, target), want)
    for name, value in (("BLOCK", 2000), ("PAIR_BYTES", 5000), ("WORD_BYTES", 20000)):
        monkeypatch.setattr(lm, name, value)  # many blocks and buckets
    agree(held(spark, texts, [*target, target[0]]), want)


def test_without_targets_the_target_model_is_uniform(spark):
    texts = ["a b c", "a b d", "e"]
    got = held(spark, texts, [])
    agree(got, brute(texts, [False] * 3))
    assert abs(got[2].target_loss - math.log(6)) < 1e-9


def test_null_and_repeated_keys_strings_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", "a c"), ("x", "a c"), ("y", None)], "doc_id string, text string").withColumn("score", F.lit(1))
    keys = spark.createDataFrame([("x",), ("x",), (None,), ("z",)], "k string")
    out = lm.score_difference(docs, keys)
    assert out.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"] and out.count() == 5
    assert lm.score_difference(docs.limit(0), keys).count() == 0
    assert lm.score_difference(docs.where("doc_id = 'y'"), keys.limit(0)).first().score is None


def test_documents_that_trained_the_target_score_like_held_out_ones(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    good = labels.where("quality = 1")
    scored = lm.score_difference(docs, good.where("doc_id % 2 = 0").select("doc_id")).join(labels, "doc_id")
    mean = {(r.quality, r.even): r.m for r in scored.groupBy("quality", (F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("score").alias("m")).collect()}
    assert abs(mean[1, True] - mean[1, False]) < 0.35 * (min(mean[0, True], mean[0, False]) - max(mean[1, True], mean[1, False]))


def test_the_query_scores_every_document(spark):
    root = "/root/testdata/sf0.001"
    assert queries.QUERIES["op1_lm_scoring"](spark, root).count() == spark.read.parquet(f"{root}/documents.parquet").count()
