"""A quality classifier: a generalised additive model with pairwise interactions, learned as tables by cyclic boosting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal
from tidemark.llm.text_features import FEATURES, text_features

#: Labelled rows that a model is fitted on, at most: those of the least hash of their key.
FIT_ROWS = 20_000
#: Bins of a feature, and of each side of a pair.
BINS, PAIR_BINS = 64, 12
#: Rounds over all features, then over all pairs; how far each tree's values count; pairs that are kept.
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 120, 60, 0.15, 10
#: Leaves of a feature's tree; second derivatives that a leaf has at least, and that each value is drawn to 0 with.
LEAVES, LEAST, DRAWN = 3, 2.0, 1.0
#: Of so many rows one is set aside to choose the number of rounds.
ASIDE = 6


@dataclass
class Model:
    """Edges of each feature's bins, a table of a value for each bin, and tables for pairs of features over coarser bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """The sum of what the tables hold for each row's bins."""
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[bins[i], bins[j]]
        return total


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(log_odds, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges between bins of about equal frequency; fewer where values repeat."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + DRAWN)


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of LEAVES leaves over ordered bins with gradients ``g`` and second derivatives ``h``: the best cut, again and again."""
    cuts = [0, len(g)]
    up, uh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(LEAVES - 1):
        best, at = 1e-9, 0
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z - a < 2:
                continue
            m = np.arange(a + 1, z)
            left, right = (up[m] - up[a], uh[m] - uh[a]), (up[z] - up[m], uh[z] - uh[m])
            won = np.where((left[1] >= LEAST) & (right[1] >= LEAST), _gain(*left) + _gain(*right) - _gain(up[z] - up[a], uh[z] - uh[a]), 0.0)
            if won.max() > best:
                best, at = won.max(), int(m[won.argmax()])
        if not at:
            break
        cuts = sorted({*cuts, at})
    values = np.zeros(len(g))
    for a, z in zip(cuts, cuts[1:], strict=False):
        values[a:z] = -(up[z] - up[a]) / (uh[z] - uh[a] + DRAWN)
    return values


def _cut_twice(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree over a grid that cuts rows first and then the columns of each part on its own."""
    best, values = 0.0, np.zeros_like(g)
    ug, uh = g.cumsum(axis=0), h.cumsum(axis=0)
    whole = _gain(g.sum(), h.sum())
    for r in range(len(g) - 1):
        won, parts = -whole, []
        for pg, ph in ((ug[r], uh[r]), (ug[-1] - ug[r], uh[-1] - uh[r])):
            lg, lh = pg.cumsum(), ph.cumsum()
            each = _gain(lg[:-1], lh[:-1]) + _gain(lg[-1] - lg[:-1], lh[-1] - lh[:-1])
            each[(lh[:-1] < LEAST) | (lh[-1] - lh[:-1] < LEAST)] = -1.0
            c = int(each.argmax())
            if each[c] < 0:
                won += _gain(lg[-1], lh[-1])
                parts.append(np.full(g.shape[1], -lg[-1] / (lh[-1] + DRAWN)))
            else:
                won += each[c]
                parts.append(np.where(np.arange(g.shape[1]) <= c, -lg[c] / (lh[c] + DRAWN), -(lg[-1] - lg[c]) / (lh[-1] - lh[c] + DRAWN)))
        if won > best:
            best, values = won, np.concatenate([np.tile(parts[0], (r + 1, 1)), np.tile(parts[1], (len(g) - r - 1, 1))])
    return best, values


def _best_grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    rows, columns = _cut_twice(g, h), _cut_twice(g.T, h.T)
    return rows if rows[0] >= columns[0] else (columns[0], columns[1].T)


class _Boosting:
    """Cyclic boosting of tables. ``log_odds`` has what they sum to for each row; rows ``own`` teach, rows ``judge`` choose the round."""

    def __init__(self, y: np.ndarray, own: np.ndarray, judge: np.ndarray, start: float):
        self.y, self.own, self.judge, self.log_odds = y, own, judge, np.full(len(y), start)

    def derivatives(self, cell: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The loss's first and second derivatives, summed over the rows that teach in each cell."""
        p = probability(self.log_odds[self.own])
        sums = [np.bincount(cell[self.own], weights=w, minlength=int(np.prod(shape))).reshape(shape) for w in (p - self.y[self.own], p * (1 - p))]
        return sums[0], sums[1]

    def loss(self) -> float:
        y, t = self.y[self.judge], self.log_odds[self.judge]
        return float(np.mean(np.logaddexp(0, t) - y * t))

    def run(self, cells: list[np.ndarray], shapes: list[tuple[int, ...]], rounds: int, tree: Callable) -> list[np.ndarray]:
        """A table for each of ``cells``: the sums of RATE times a tree's values in each round, up to the round of the least loss."""
        tables = [np.zeros(s) for s in shapes]
        least, kept, sums = self.loss(), [t.copy() for t in tables], self.log_odds.copy()
        for _ in range(rounds):
            for cell, values in zip(cells, tables, strict=True):
                step = RATE * tree(*self.derivatives(cell, values.shape))
                values += step
                self.log_odds += step.ravel()[cell]
            if (now := self.loss()) < least - 1e-6:
                least, kept, sums = now, [t.copy() for t in tables], self.log_odds.copy()
        self.log_odds = sums
        return kept


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the chance that ``y`` is 1. Rows of one kind, or none at all, give an intercept and nothing else.

    First a table for each feature; then, of all pairs of features, the PAIRS whose grid explains most of what is left."""
    n, ones = len(y), float(y.sum())
    model = Model(intercept=float(np.log((ones + 1) / (n - ones + 1))))
    if not 0 < ones < n:
        return model
    judge = np.arange(n) % ASIDE == 0
    own = ~judge
    if n < 20 * ASIDE:  # too few to set some aside
        own, judge = np.ones(n, bool), np.ones(n, bool)
    boosting = _Boosting(y, own, judge, model.intercept)
    features = range(x.shape[1])
    model.edges = [_edges(x[:, j], BINS) for j in features]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in features]
    model.tables = boosting.run(bins, [(len(e) + 1,) for e in model.edges], ROUNDS, _shallow)
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in features]
    bins = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in features]
    sizes = [len(e) + 1 for e in model.coarse]
    grids = {(i, j): bins[i] * sizes[j] + bins[j] for i, j in combinations(features, 2)}
    gains = {pair: _best_grid(*boosting.derivatives(cell, (sizes[pair[0]], sizes[pair[1]])))[0] for pair, cell in grids.items()}
    model.pairs = sorted(sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS])
    grid = lambda g, h: _best_grid(g, h)[1]
    model.pair_tables = boosting.run([grids[p] for p in model.pairs], [(sizes[i], sizes[j]) for i, j in model.pairs], PAIR_ROUNDS, grid)
    for values, weight in [(t, np.bincount(c, minlength=t.size)) for t, c in zip([*model.pair_tables], [grids[p] for p in model.pairs], strict=True)]:
        mean = float((values.ravel() * weight).sum() / n)  # a pair's table says what differs from its mean
        values -= mean
        model.intercept += mean
    return model


def featured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and ``x``, the FEATURES of each text: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = text_features(b.column(len(keep)))
            x = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], [*[str(i) for i in range(len(keep))], "x"])

    kinds = ", ".join(f"`{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(*[F.col(f"`{c}`") for c in (*keep, text)]).mapInArrow(frugal(run), f"{kinds}, x array<double>")
    return out.toDF(*keep, "x")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model learned from the labelled ``docs``: all of them, or the ``rows`` labels whose key has the least hash.

    That bound is what reaches the driver: a row of FEATURES for each. Labels are 0 or 1; others, and null keys, teach nothing.
    A repeated label counts each time. Texts are read where they are; only the labels, bounded, are sent to them.
    """
    known = labels.where(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{key}`").alias("__tm_key"), F.col(f"`{label}`").cast("int").alias("__tm_y")).dropna()
    known = known.withColumn("__tm_h", F.xxhash64(F.col("__tm_key").cast("string"))).orderBy("__tm_h", "__tm_key", "__tm_y").limit(rows)
    named = docs.select(F.col(f"`{key}`").alias("__tm_doc"), F.col(f"`{text}`").alias("__tm_text"))
    met = named.join(F.broadcast(known), F.col("__tm_doc") == F.col("__tm_key"))
    found = featured(met, ["__tm_h", "__tm_doc", "__tm_y"], "__tm_text").toPandas()
    if found.empty:
        return learn(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(found["x"].to_numpy())
    y = found["__tm_y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y, found["__tm_doc"].to_numpy(), found["__tm_h"].to_numpy()))  # sums of floats depend on the order
    return learn(x[order], y[order])


def score_quality(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score``, from 0 to 1, for each row of ``docs``: the higher, the likelier is label 1.

    A narrow pass without a shuffle: texts give their FEATURES, these give bins, and the bins' values are added up for a whole
    batch. Only the text enters a score. Null text is empty, and empty texts have a score as well, that of statistics which are
    all 0. Equal texts have equal scores; null or repeated keys are rows of their own; an empty table gives none. A very long
    text is read in pieces (see ``text_features``). Only ``key`` and ``text`` are read, so other columns can have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = probability(model.log_odds(text_features(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(frugal(run), f"key {kind}, score double").toDF(key, "score")
