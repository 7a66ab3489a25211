"""Quality rules: base limits, then robust multivariate outliers of text statistics."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, anti_listed, let, words

#: The transformed statistics of a text, with the least standard deviation that each is held to have.
FEATURES = {"word_length": 0.05, "symbols": 0.03, "dup_lines": 0.1, "repeat_words": 0.1, "capitals": 0.03}
#: The counts behind them, of which each language has a typical number for a word.
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Share of a group in the covariance's subset, and what makes the covariance of that share of a five-variate normal right.
SUPPORT, CONSISTENCY = 0.75, 1.415
#: Squared distance that one in ten million of a five-variate normal exceeds: clean documents come by the million.
CUTOFF = 42.0
#: Words of typical text that each text is lengthened by, so that few words alone make no outlier.
PRIOR_WORDS = 25
#: Documents that what a group leans on counts as: five for each of the five statistics.
LEAN = 25
#: Medians are read from bins of 1 / FINE; steps are taken until no determinant's logarithm falls by STILL.
FINE, STILL = 512.0, 1e-6
#: Group tables of at most so many rows are broadcast.
BROADCAST_ROWS = 50_000


def _windows(ws: Column) -> Column:
    """A hash of each window of five words."""
    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))


def _covered(windows: Column) -> Column:
    """Words in windows that come twice or more: equal windows stand side by side once sorted."""
    placed = F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    again = let(placed, lambda s: F.filter(F.transform(s, lambda x, i: F.when((x["v"] == F.get(s, i + 1)["v"]) | ((i > 0) & (x["v"] == F.get(s, i - 1)["v"])), x["i"])), lambda x: x.isNotNull()))
    return let(F.sort_array(again), lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 5).otherwise(F.least(F.lit(5), x - F.get(p, i - 1)))), F.lit(0), lambda a, b: a + b))


def repeat_words(ws: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text. Texts without such a window need no sort."""
    return F.when(F.size(ws) < 6, 0).otherwise(let(_windows(ws), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w)))).cast("long")


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals; 0 for null text."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("__tm_words", words(F.col(text))).withColumn("__tm_lines", lines)
    return out.withColumns({
        "n_words": F.size("__tm_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(value, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__tm_lines") - F.size(F.array_distinct("__tm_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__tm_words")),
        "n_lines": F.size("__tm_lines").cast("long"),
        "n_capitals": F.length(F.regexp_replace(value, r"[^\p{Lu}]+", "")).cast("long"),
    }).drop("__tm_words", "__tm_lines")


def _features() -> dict[str, Column]:
    """The transformed statistics of a text with PRIOR_WORDS words of its language's typical text (``__tm_t_*``, for a word) behind it."""
    words = F.col("n_words") + PRIOR_WORDS
    c = {k: F.col(k) + PRIOR_WORDS * F.col(f"__tm_t_{k}") for k in COUNTS}
    return {
        "word_length": F.log((c["word_chars"] + 1) / words),
        "symbols": F.sqrt(c["n_symbols"] / (c["word_chars"] + 1)),
        "dup_lines": F.sqrt(c["n_dup_lines"] / (c["n_lines"] + 1)),
        "repeat_words": F.sqrt(c["n_repeat_words"] / words),
        "capitals": F.sqrt(c["n_capitals"] / (c["word_chars"] + 1)),
    }


def _medians(scratch: Scratch, label: str, rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``by``, ``__tm_j`` (the place in ``names``), ``__tm_med`` and ``__tm_mad``: the bins of the medians and of the median absolute deviations.

    Sums over a fixed number of bins for each group, so map-side aggregation leaves a row for each bin and task."""
    each = rows.select(*by, F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("__tm_j", "__tm_x")).select(*by, "__tm_j", F.floor(F.col("__tm_x") * FINE).alias("__tm_b"))
    bins = scratch.keep(label, each.groupBy(*by, "__tm_j", "__tm_b").agg(F.count(F.lit(1)).alias("__tm_n")))
    one = Window.partitionBy(*by, "__tm_j")
    upto = lambda c: F.sum("__tm_n").over(one.orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    half = F.col("__tm_upto") * 2 >= F.col("__tm_all")
    med = bins.select("*", upto("__tm_b").alias("__tm_upto"), F.sum("__tm_n").over(one).alias("__tm_all"))
    med = med.withColumn("__tm_med", F.min(F.when(half, F.col("__tm_b"))).over(one)).withColumn("__tm_off", F.abs(F.col("__tm_b") - F.col("__tm_med")))
    mad = med.withColumn("__tm_upto", upto("__tm_off"))
    return mad.groupBy(*by, "__tm_j", "__tm_med").agg(F.min(F.when(half, F.col("__tm_off"))).alias("__tm_mad"))


def _few(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], small: bool | None = None) -> DataFrame:
    """``rows`` with the columns of their group; nulls are equal. A group table over BROADCAST_ROWS is joined by shuffle,
    where the engine splits hot groups. ``small``: whether it isn't, if that is known."""
    right = groups.select(*[F.col(c).alias(f"__tm_r{i}") for i, c in enumerate(on)], *[c for c in groups.columns if c not in on])
    cond = [rows[c].eqNullSafe(right[f"__tm_r{i}"]) for i, c in enumerate(on)]
    small = _few(right) if small is None else small
    return rows.join(F.broadcast(right) if small else right, cond, "inner").drop(*[f"__tm_r{i}" for i in range(len(on))])


def _with_factor(df: DataFrame, p: int) -> DataFrame:
    """``df`` with the inverse ``__tm_w*_*`` of the lower Cholesky factor of ``__tm_c*_*``, and the determinant's logarithm ``__tm_det``.

    Each column is computed once, from those before it in the same select, so the plan doesn't grow with their nesting."""
    minus = lambda start, xs: " - ".join([start, *xs])
    low, inv = (lambda i, j: f"__tm_l{i}_{j}"), (lambda i, j: f"__tm_w{i}_{j}")
    made = []
    for j in range(p):
        made.append(f"sqrt({minus(f'__tm_c{j}_{j}', [f'{low(j, k)} * {low(j, k)}' for k in range(j)])}) AS {low(j, j)}")
        made += [f"({minus(f'__tm_c{i}_{j}', [f'{low(i, k)} * {low(j, k)}' for k in range(j)])}) / {low(j, j)} AS {low(i, j)}" for i in range(j + 1, p)]
    for i in range(p):
        made.append(f"1 / {low(i, i)} AS {inv(i, i)}")
        made += [f"({minus('0.0D', [f'{low(i, k)} * {inv(k, j)}' for k in range(j, i)])}) / {low(i, i)} AS {inv(i, j)}" for j in range(i)]
    made.append(f"2 * ({' + '.join(f'ln({low(i, i)})' for i in range(p))}) AS __tm_det")
    return df.selectExpr("*", *made).select(*df.columns, "__tm_det", *[inv(i, k) for i in range(p) for k in range(i + 1)])


def _distance(names: list[str]) -> Column:
    z = [sum(((F.col(names[k]) - F.col(f"__tm_m{k}")) * F.col(f"__tm_w{i}_{k}") for k in range(i + 1)), F.lit(0.0)) for i in range(len(names))]
    return sum((x * x for x in z), F.lit(0.0))


def fit_mcd(scratch: Scratch, rows: DataFrame, names: list[str], floors: list[float], *, support: float = SUPPORT) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group ``__tm_g``: its rows ``__tm_n``, centre ``__tm_m*``, covariance ``__tm_c*_*``.

    Two deterministic starts, distances from the coordinatewise medians by the median absolute deviations and by the floors.
    Each step takes the ``support`` share with the least distances, gets its mean and covariance, and measures the distances
    anew. A group goes on as long as its determinant falls, and the floors bound that from below; the start that ends with
    the smaller one stays. Medians come from a fixed number of bins for each group. A step reads the rows once: each bin of
    distances gets its count, sums and products, which give both the limit and the estimates. Map-side aggregation leaves
    a row for each group, bin and task, so a hot group is no burden. Floors are added to the covariance's diagonal, so no
    group is singular.
    """
    p = len(names)
    mad = _medians(scratch, "bins", rows, ["__tm_g"], names)
    scale = F.greatest(1.4826 * F.col("__tm_mad") / FINE, F.element_at(F.array(*[F.lit(f) for f in floors]), F.col("__tm_j") + 1))
    mad = mad.select("__tm_g", "__tm_j", ((F.col("__tm_med") + 0.5) / FINE).alias("__tm_c"), scale.alias("__tm_s"))
    start = mad.groupBy("__tm_g").agg(*[F.max(F.when(F.col("__tm_j") == j, F.col(c))).alias(f"{c}{j}") for j in range(p) for c in ("__tm_c", "__tm_s")])
    start = start.withColumn("__tm_start", F.explode(F.array(F.lit(0), F.lit(1))))
    by = [F.when(F.col("__tm_start") == 0, F.col(f"__tm_s{j}")).otherwise(F.lit(floors[j])) for j in range(p)]
    means, covs = [f"__tm_m{j}" for j in range(p)], [f"__tm_c{i}_{j}" for i in range(p) for j in range(i + 1)]
    factors = [f"__tm_w{i}_{k}" for i in range(p) for k in range(i + 1)]
    first = {c: F.lit(None).cast("double") for c in covs} | {f"__tm_m{j}": F.col(f"__tm_c{j}") for j in range(p)} | {f"__tm_w{i}_{k}": 1 / by[i] if i == k else F.lit(0.0) for i in range(p) for k in range(i + 1)}
    model = start.select("__tm_g", "__tm_start", F.lit(float("inf")).alias("__tm_det"), F.lit(0).cast("long").alias("__tm_n"), *[x.alias(c) for c, x in first.items()])
    model, own, done = scratch.keep("model0", model), ["__tm_g", "__tm_start"], []
    small = _few(model)
    dev = [F.col(names[j]) - F.col(f"__tm_m{j}") for j in range(p)]
    parts = {f"__tm_d{j}": dev[j] for j in range(p)} | {f"__tm_q{i}_{j}": dev[i] * dev[j] for i in range(p) for j in range(i + 1)}
    pair = Window.partitionBy(*own)
    for step in count():
        bin_ = F.least(F.floor(F.log1p(_distance(names)) * 200), F.lit(8191)).alias("__tm_bin")
        bins = join_groups(rows, model, ["__tm_g"], small).groupBy(*own, bin_).agg(F.count(F.lit(1)).alias("__tm_k"), *[F.sum(x).alias(c) for c, x in parts.items()])
        before = F.coalesce(F.sum("__tm_k").over(pair.orderBy("__tm_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("__tm_before", before).withColumn("__tm_all", F.sum("__tm_k").over(pair)).where(F.col("__tm_before") < F.col("__tm_all") * support)
        sums = bins.groupBy(*own, "__tm_all").agg(*[F.sum(c).alias(c) for c in ("__tm_k", *parts)])
        mean = [F.col(f"__tm_d{j}") / F.col("__tm_k") for j in range(p)]
        cov = [[(F.col(f"__tm_q{i}_{j}") / F.col("__tm_k") - mean[i] * mean[j]) * CONSISTENCY + F.lit(floors[i] ** 2 if i == j else 0.0) for j in range(i + 1)] for i in range(p)]
        new = sums.select(*own, F.col("__tm_all").alias("__tm_n"), *[mean[j].alias(f"__tm_m{j}") for j in range(p)], *[cov[i][j].alias(f"__tm_c{i}_{j}") for i in range(p) for j in range(i + 1)])
        new = _with_factor(new, p)
        old = model.select(*own, *[F.col(c).alias(f"__tm_old{c}") for c in model.columns if c not in own])
        both = old.join(new, own).withColumns({c: F.col(c) + F.col(f"__tm_old{c}") for c in means})
        both = scratch.keep(f"step{step}", both)
        fell = F.col("__tm_det") < F.col("__tm_old__tm_det") - STILL
        done.append(both.where(~fell).select(*own, F.col("__tm_old__tm_det").alias("__tm_det"), "__tm_n", *[F.col(f"__tm_old{c}").alias(c) for c in (*means, *covs)]))
        last = both.where(fell).select(*own, "__tm_det", "__tm_n", *means, *covs, *factors)
        model = last.select(*model.columns)
        if model.isEmpty():
            break
    done.append(last.drop(*factors))
    best = Window.partitionBy("__tm_g").orderBy("__tm_det", "__tm_start")
    best = reduce(DataFrame.unionByName, done).withColumn("__tm_r", F.row_number().over(best)).where("__tm_r = 1")
    fitted = scratch.keep("fitted", best.select("__tm_g", "__tm_n", *means, *covs))
    for name in ("bins", "model0", *(f"step{i}" for i in range(step + 1))):
        scratch.drop(name)
    return fitted


def _leaning(scratch: Scratch, fitted: DataFrame, groups: DataFrame, p: int, lean: int) -> DataFrame:
    """For each row of ``groups`` (``__tm_level0``, the whole, to its own group) the estimates, drawn to those of the level above.

    A group of n rows has the weight n / (n + ``lean``) against its level above, so a large group stands for itself and a
    small one for its language.
    """
    names = [f"__tm_m{j}" for j in range(p)] + [f"__tm_c{i}_{j}" for i in range(p) for j in range(i + 1)]
    levels = [c for c in groups.columns if c.startswith("__tm_level")]
    out = groups
    for k, level in enumerate(levels):
        own = fitted.select(F.col("__tm_g").alias(level), F.col("__tm_n").alias("__tm_on"), *[F.col(c).alias(f"__tm_o{c}") for c in names])
        out = join_groups(out, own, [level])
        weight = F.col("__tm_on") / (F.col("__tm_on") + lean)
        new = {c: F.col(f"__tm_o{c}") if k == 0 else weight * F.col(f"__tm_o{c}") + (1 - weight) * F.col(c) for c in names}
        out = out.withColumns(new).drop("__tm_on", *[f"__tm_o{c}" for c in names])
    out = scratch.keep("drawn", out.select(F.col(levels[-1]).alias("__tm_g"), *names))
    return scratch.keep("model", _with_factor(out, p).select("__tm_g", *[f"__tm_m{j}" for j in range(p)], *[f"__tm_w{i}_{k}" for i in range(p) for k in range(i + 1)]))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, lean: int = LEAN) -> DataFrame:
    """The statistics and the verdict for each row of ``docs``: ``key``, the counts of ``text_stats``, ``base_failed``,
    ``distance`` and ``kept``, beside ``__tm_text_hash``.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated five-word windows. All other rows are described
    by FEATURES, each as if PRIOR_WORDS words of its language's typical text (medians for a word) stood behind it. Every
    language and source has estimates of its own (see ``fit_mcd``), drawn to those of its language and these to the whole's
    as if ``lean`` rows spoke for the level above. A row whose squared Mahalanobis distance exceeds ``cutoff`` is rejected.

    One pass over the texts writes the counts, and everything after it works on those. Null text has no words and fails
    the base; null languages and sources are values of their own; null or repeated keys are rows of their own. Very long
    texts are counted whole. A table with no row that passes the base, or an empty one, needs no fit. Columns of ``docs``
    other than those named aren't read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    keys = [f"__tm_k{i}" for i in range(len(groups))]
    own = docs.select(key, *[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(text).alias("__tm_text"))
    stats = text_stats(own, "__tm_text").withColumn("__tm_text_hash", F.xxhash64("__tm_text")).drop("__tm_text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = scratch.keep("stats", stats.withColumn("base_failed", failed))
    levels = {f"__tm_level{i}": F.to_json(F.struct(F.lit(i).alias("__tm_level"), *keys[:i])) for i in range(len(keys) + 1)}
    passed = stats.where("NOT base_failed").withColumns(levels)

    top = list(levels)[min(1, len(keys))]
    typical = _medians(scratch, "typical_bins", passed.select(top, *[(F.col(c) / F.col("n_words")).alias(c) for c in COUNTS]), [top], list(COUNTS))
    typical = typical.groupBy(top).agg(*[F.max(F.when(F.col("__tm_j") == j, F.col("__tm_med") / FINE)).alias(f"__tm_t_{c}") for j, c in enumerate(COUNTS)])
    tested = scratch.keep("tested", join_groups(passed, scratch.keep("typical", typical), [top]).withColumns(_features()))
    names = list(FEATURES)
    fitted = fit_mcd(scratch, tested.select(F.explode(F.array(*levels)).alias("__tm_g"), *names), names, list(FEATURES.values()))
    model = _leaning(scratch, fitted, tested.select(*levels).distinct(), len(names), lean)
    shown = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = join_groups(tested.withColumnRenamed(list(levels)[-1], "__tm_g"), model, ["__tm_g"]).withColumn("distance", _distance(names))
    judged = judged.select(*shown, "distance", (F.col("distance") <= cutoff).alias("kept"), "__tm_text_hash")
    out = stats.where("base_failed").select(*shown, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"), "__tm_text_hash")
    return judged.unionByName(out)


def keep_good(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Rows with equal keys and texts share a verdict."""
    bad = judge(docs, key=key, text=text, **rules).where("NOT kept").select(F.col(key).alias("__tm_key"), "__tm_text_hash").distinct()
    bad = Scratch(docs.sparkSession, "rejected").keep("bad", bad)
    return anti_listed(docs, F.xxhash64(text), bad, "__tm_text_hash", lambda d, b: d[key].eqNullSafe(b["__tm_key"]) & (F.xxhash64(d[text]) == b["__tm_text_hash"]))
