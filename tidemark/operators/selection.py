"""Operators that choose, order and screen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score (a number) of each key; ties go to the least ``tie``, null scores lose. A map-side aggregate, no sort."""
    others = [c for c in rows.columns if c not in keys]
    ranked = F.struct(F.col(score).isNull(), -F.col(score), F.col(tie))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), ranked).alias("m")).select(*keys, "m.*")


def in_order(items: DataFrame, brief: DataFrame, key: str, position: str) -> DataFrame:
    """The items that a brief names, with their positions; what the brief doesn't name is left out."""
    return items.join(brief.select(key, position), key)


def capped(items: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """The longest prefix of each key, in ``order``, whose running ``cost`` (``total``) stays within ``cap``."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = items.withColumn("total", F.sum(cost).over(running))
    return totals.withColumn("__worst", F.max("total").over(running)).where(F.col("__worst") <= cap).drop("__worst")


def two_layers(kept: DataFrame, layers: dict[str, tuple[DataFrame, list[str]]], show: list[str]) -> DataFrame:
    """The rows of ``kept`` that a layer of checks doesn't find, each with the name of the ``layer``."""
    failed = [kept.join(found.select(*on).distinct(), on, "left_anti").select(*show, F.lit(name).alias("layer")) for name, (found, on) in layers.items()]
    out = failed[0]
    for f in failed[1:]:
        out = out.unionByName(f)
    return out


def same_source(cut: DataFrame, pool: DataFrame, source: str, item: str) -> DataFrame:
    """Material for each source of a cut that comes from the same source and isn't in the cut."""
    return pool.join(cut.select(source).distinct(), source, "left_semi").join(cut.select(item), item, "left_anti")


def screened(rows: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Rows whose text matches none of the named patterns. Null text matches nothing and stays."""
    bad = F.lit(False)
    for pattern in rules.values():
        bad = bad | F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    return rows.where(~bad)


def fillers(words: DataFrame, word: str, listed: list[str]) -> DataFrame:
    """Words of a fixed list, whatever their case."""
    return words.where(F.lower(word).isin(*listed))


def abandoned(lines: DataFrame, keys: list[str], order: str, text: str, shared: int) -> DataFrame:
    """Lines whose first ``shared`` characters the next line of the same key begins with again: starts given up and retaken."""
    follow = F.lead(text).over(Window.partitionBy(*keys).orderBy(order))
    head = F.substring(text, 1, shared)
    return lines.withColumn("__next", follow).where((F.length(head) == shared) & (F.substring("__next", 1, shared) == head)).drop("__next")


def exposed(tools: DataFrame, profile: list[str], packs: list[str]) -> DataFrame:
    """Tools whose requirements the profile meets and that are in a chosen pack; a pack adds no authority."""
    own, chosen = F.array(*[F.lit(p) for p in profile]).cast("array<string>"), F.array(*[F.lit(p) for p in packs]).cast("array<string>")
    return tools.where((F.size(F.array_except("requires", own)) == 0) & F.arrays_overlap("packs", chosen))


def capabilities(tools: DataFrame, name: str, profile: list[str]) -> DataFrame:
    """(``name``, ``available``): whether the profile meets all that a tool requires. A tool whose requirements aren't known isn't available."""
    own = F.array(*[F.lit(p) for p in profile]).cast("array<string>")
    return tools.select(name, F.coalesce(F.size(F.array_except("requires", own)) == 0, F.lit(False)).alias("available"))


def children(items: DataFrame, path: str, folder: list[str] | None = None) -> DataFrame:
    """The items right below ``folder``, the root if it is None; ``path`` has an item's folders and then its own name. Nothing is listed below that."""
    folder = folder or []
    here = F.slice(path, 1, F.lit(len(folder))) == F.array(*[F.lit(f) for f in folder]).cast("array<string>") if folder else F.lit(True)
    return items.where((F.size(path) == len(folder) + 1) & here)


def checked_alone(spans: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each span with ``failed``, the names of the checks that it doesn't pass by itself; a check that gives null isn't passed. No shuffle."""
    named = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(n)) for n, ok in checks.items()]
    return spans.withColumn("failed", F.array_compact(F.array(*named)))


def top(rows: DataFrame, score: Column, tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the highest score; ties go to the least ``tie``. Each task keeps k rows."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), tie).limit(k)


def measured(rows: DataFrame, measures: dict[str, tuple[Column, float]], tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the highest ``score``: the weighted sum of the named measures, each brought to 0..1 by its range over all rows.

    A measure that is the same everywhere counts as 0, a null one as 0. Only the ranges, two numbers a measure, reach the driver.
    """
    own = rows.withColumns({name: x.cast("double") for name, (x, _) in measures.items()})
    found = own.agg(*[f(name).alias(f"{f.__name__}_{name}") for name in measures for f in (F.min, F.max)]).first()
    score = F.lit(0.0)
    for name, (_, weight) in measures.items():
        low, high = found[f"min_{name}"], found[f"max_{name}"]
        if low is not None and high > low:
            score = score + weight * F.coalesce((F.col(name) - low) / (high - low), F.lit(0.0))
    return top(own, score, tie, k)


def report(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """How many decisions of each kind and status there are."""
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
