import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import Scratch

ROOT = "/root/testdata/sf0.001"


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    count = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


HARD = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 40, "one\n\none\n two \n two ", "# * $ % & | < >", "a\x0bb\x0cc d e", "ä ö " * 3 + "𝒳 𝒴", "w" * 100_000]


def table(spark):
    rows = [(-i - 1, t, "en", "s", 1) for i, t in enumerate(HARD)] + [(None, "no key here " * 3, None, None, 1), (7, "again", "en", "s", 1), (7, "again", "en", "s", 1)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    return own.unionByName(spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(1).alias("n_words")))


def test_base_is_as_specified(spark):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(table(spark)).collect())
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in table(spark).collect())


def test_empty_table_and_one_without_good_rows(spark):
    assert quality.judge(table(spark).limit(0)).collect() == []
    assert {r.kept for r in quality.judge(table(spark).where("doc_id < 0 AND doc_id > -4")).collect()} == {False}
    assert quality.keep_good(table(spark).limit(0)).columns == table(spark).columns


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    clean = [" ".join(rng.choice(words).capitalize() if i % 9 == 0 else rng.choice(words) for i in range(rng.randrange(30, 300))) for _ in range(400)]
    junk = [" ".join(w + "&&&" for w in t.split()) for t in clean[:25]] + [t.upper() for t in clean[25:50]]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 40}", "x") for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(400))


def lower_median(bins):
    """The least bin that half of the values don't exceed."""
    return np.sort(bins)[int(np.ceil(len(bins) / 2)) - 1]


def numpy_fit(x, floors):
    """(rows, centre, covariance) of the start that ends with the smaller determinant."""
    bins = np.floor(x * quality.FINE)
    med = np.array([lower_median(b) for b in bins.T])
    mad = np.array([lower_median(abs(b - m)) for b, m in zip(bins.T, med, strict=True)])
    ends = []
    for scale in (np.maximum(1.4826 * mad / quality.FINE, floors), floors):
        d = (((x - (med + 0.5) / quality.FINE) / scale) ** 2).sum(axis=1)
        det, held = np.inf, None
        while True:
            ranks = np.minimum(np.floor(np.log1p(d) * 200), 8191)
            inside = x[ranks <= np.sort(ranks)[int(np.ceil(quality.SUPPORT * len(x))) - 1]]
            mean = inside.mean(axis=0)
            cov = np.cov(inside.T, bias=True) * quality.CONSISTENCY + np.diag(np.square(floors))
            if np.linalg.slogdet(cov)[1] >= det - quality.STILL:
                break
            det, held = np.linalg.slogdet(cov)[1], (mean, cov)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        ends.append((det, *held))
    _, mean, cov = min(ends, key=lambda e: e[0])
    return len(x), mean, cov


def test_estimates_are_the_determinants_least(spark):
    """Against numpy on one group with a fifth of outliers: the steps end where nothing moves."""
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([1, 2, 3], [[1, 0.5, 0], [0.5, 2, 0.3], [0, 0.3, 0.5]], 4000) / 4
    x[:800] += 3
    names, floors = ["a", "b", "c"], [0.01, 0.01, 0.01]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "__tm_g string, a double, b double, c double")
    model = quality.fit_mcd(Scratch(spark, "t"), df, names, floors).first()
    n, mean, cov = numpy_fit(x, np.array(floors))
    assert model["__tm_n"] == n
    assert np.allclose([model[f"__tm_m{j}"] for j in range(3)], mean, atol=1e-9)
    assert np.allclose([[model[f"__tm_c{max(i, j)}_{min(i, j)}"] for j in range(3)] for i in range(3)], cov, atol=1e-9)


def test_verdicts_of_a_whole_table_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(20).selectExpr("doc_id + 5000 AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars"))
    stats = quality.text_stats(docs).toPandas()
    failed = (stats.n_words < 10) | (100 * stats.n_repeat_words > 20 * stats.n_words)
    t = stats[~failed].copy()
    t["lang"] = t["lang"].fillna("")
    for c in quality.COUNTS:
        t[f"typical_{c}"] = t.groupby("lang")[c].transform(lambda x: lower_median(np.floor(x / t.loc[x.index, "n_words"] * quality.FINE)) / quality.FINE)
    p = quality.PRIOR_WORDS
    c = {k: t[k] + p * t[f"typical_{k}"] for k in quality.COUNTS}
    x = np.stack([
        np.log((c["word_chars"] + 1) / (t.n_words + p)), np.sqrt(c["n_symbols"] / (c["word_chars"] + 1)), np.sqrt(c["n_dup_lines"] / (c["n_lines"] + 1)),
        np.sqrt(c["n_repeat_words"] / (t.n_words + p)), np.sqrt(c["n_capitals"] / (c["word_chars"] + 1)),
    ], axis=1)
    floors = np.array([*quality.FEATURES.values()])
    whole = numpy_fit(x, floors)
    want = {}
    for lang in t["lang"].unique():
        a = (t["lang"] == lang).to_numpy()
        n, mean, cov = numpy_fit(x[a], floors)
        w = n / (n + quality.LEAN)
        above = w * mean + (1 - w) * whole[1], w * cov + (1 - w) * whole[2]
        for source in t["source"][a].unique():
            b = a & (t["source"] == source).to_numpy()
            n, mean, cov = numpy_fit(x[b], floors)
            w = n / (n + quality.LEAN)
            dev = x[b] - w * mean - (1 - w) * above[0]
            d = np.einsum("ij,jk,ik->i", dev, np.linalg.inv(w * cov + (1 - w) * above[1]), dev)
            want |= dict(zip(t["doc_id"][b], d, strict=True))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert {k for k, r in got.items() if r.base_failed} == set(stats.doc_id[failed]) and not any(r.kept for r in got.values() if r.base_failed)
    assert all(abs(got[k].distance - d) < 1e-6 * max(1, d) and got[k].kept == (d <= quality.CUTOFF) for k, d in want.items())
    assert len(want) + failed.sum() == len(got) and 0 < sum(d > quality.CUTOFF for d in want.values()) < 0.2 * len(got)
