import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.common import Scratch
from tidemark.llm.components import components
from tidemark.llm.jaccard_join import keep_first, link_similar


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    """(n_shingles, component) for each id by comparing all pairs."""
    sets = {}
    for k, t in rows:
        sets.setdefault(k, []).append(shingles(t))
    root = {k: k for k in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((k, len(shingles(t)), find(k)) for k, t in rows if k is not None)


def corpus(seed, n):
    """Copies from exact to far, chains of drifting copies, passages shared by unlike texts, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    text = lambda m: [rng.choice(words) for _ in range(m)]
    out, passage = [], text(60)
    base = [text(rng.randrange(20, 90)) for _ in range(n // 8)]
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(t[rng.randrange(0, 3) :] if rng.random() < 0.3 else t)
    drift = text(80)
    for i in range(40):
        drift = [*drift]
        drift[rng.randrange(80)] = f"new{i}"
        out.append(drift)
    out += [text(rng.randrange(5, 40)) + passage + text(rng.randrange(5, 40)) for _ in range(n // 4)]
    out += [text(rng.randrange(0, 6)) for _ in range(20)]
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, members, labels, together, frequent", [(1, 64, 10**6, 4096, 1 << 18), (2, 3, 0, 2, 200)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, seed, members, labels, together, frequent):
    """Also with small blocks, nothing broadcast, salted shingles and more repeated shingles than are listed."""
    for name, value in (("MEMBERS", members), ("QUERIES", 5), ("LABEL_ROWS", labels), ("TOGETHER", together), ("FREQUENT", frequent)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(seed, 240)
    got = sorted(tuple(r) for r in link_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute(rows)


def test_without_frequent_shingles_the_links_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    rows = corpus(5, 80)
    assert sorted(tuple(r) for r in link_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "É two"), (7, "é two"), (8, long), (9, long + " y"), (10, "twice here"), (10, "twice here"), (11, "a b c d e"), (12, "a\tb\x0bc\rd e")]
    table = spark.createDataFrame([(*r, 1, "x") for r in [*rows, (None, "one two"), (None, "alone")]], "doc_id long, text string, n int, token string")
    got = link_similar(table).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(rows)
    assert sorted((r.n_shingles, r.component_id or -1) for r in got if r.doc_id is None) == [(1, -1), (1, 4)]
    assert link_similar(table.limit(0)).collect() == []
    kept = keep_first(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 10, 10, 11]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, **{2000 + i: 2000 for i in range(7)}}


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for n, m, both in ((100, 100, 90), (40, 900, 30), (1000, 1010, 999), (1, 300, 1), (500, 500, 0)):
        x = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = x[:n], x[n - both :]
        p, q = (np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in (a, b))
        assert both <= jaccard_join.within(p, n, q) <= both + 0.4 * (n - both) + 8 and both <= jaccard_join.within(q, m, p)
