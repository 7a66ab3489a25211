"""Choosing what fits: the most valuable items within a cap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Cells of one key's table (items times units of the cap) at most: 1 GB.
MOST_CELLS = 1 << 27


def chosen(t0: np.ndarray, t1: np.ndarray, cost: np.ndarray, value: np.ndarray, cap: int) -> np.ndarray:
    """The places of the items of the largest total value whose costs come to at most ``cap`` and of which no two overlap.

    Items are in order of ``t1``. The best of the first items within each cost follows from the best of those before: without the
    last of them, or with it and the best of those that end where it begins or sooner. Of equal totals the one without the
    later item is taken.
    """
    n = len(cost)
    if n * (cap + 1) > MOST_CELLS:
        raise ValueError(f"{n} items by a cap of {cap} units are too many; take a coarser unit")
    free = np.searchsorted(t1, t0, side="right")
    free = np.minimum(free, np.arange(n))  # an item of no length isn't before itself
    best = np.zeros((n + 1, cap + 1), np.int64)
    taken = np.zeros((n, cap + 1), bool)
    for i in range(n):
        best[i + 1] = best[i]
        c = int(cost[i])
        if c <= cap and value[i] > 0:
            with_it = best[free[i], : cap + 1 - c] + value[i]
            taken[i, c:] = with_it > best[i, c:]
            best[i + 1, c:] = np.maximum(best[i, c:], with_it)
    found, i, left = [], n, cap
    while i > 0:
        if taken[i - 1, left]:
            found.append(i - 1)
            left -= int(cost[i - 1])
            i = int(free[i - 1])
        else:
            i -= 1
    return np.array(found[::-1], np.int64)


def capped_by_value(items: DataFrame, keys: list[str], tie: str, value: str, cost: str, cap: int, t0: str | None = None, t1: str | None = None) -> DataFrame:
    """The items of each key that are worth most together within ``cap``: of their intervals no two overlap, if ``t0`` and ``t1`` are named.

    Costs and values are whole numbers, costs not negative; count durations in a unit that makes the cap some thousands at most,
    as a key takes items times cap steps and cells. Never over the cap, and never worth less than a prefix that
    doesn't overlap. Intervals are half-open, so touching ones may both stay; ends before their beginning, and nulls, put
    an item out. Ties are decided by order of ``t1`` (or ``tie``) and ``tie``. A key's items are read by one task; keys are spread.
    """
    named = [value, cost, *([t0, t1] if t0 else [])]
    known = items.dropna(subset=[*keys, *named]).where(F.col(cost) >= 0)
    if t0:
        known = known.where(F.col(t0) <= F.col(t1))
    columns = items.columns
    for c in (value, cost):
        if not isinstance(items.schema[c].dataType, LongType) and items.schema[c].dataType.typeName() not in ("integer", "short", "byte"):
            raise ValueError(f"{c} must be a whole number")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*([t1] if t0 else []), tie], kind="stable")
        n = len(rows)
        begin, end = (rows[t0].to_numpy(), rows[t1].to_numpy()) if t0 else (np.arange(n), np.arange(n))
        return rows.iloc[chosen(begin, end, rows[cost].to_numpy(np.int64), rows[value].to_numpy(np.int64), cap)][columns]

    return known.groupBy(*keys).applyInPandas(run, items.schema)
