"""Counts of distinct values from sketches that are kept and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The logarithm of a sketch's registers: 4096 of them, some KB whatever it counts.
REGISTERS = 12
#: The relative standard error of merged sketches of that size, 1.04 over the square root of their registers, and how many of it are the stated bound.
ERROR, DEVIATIONS = 1.04 / 64, 4


def sketched(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """A sketch of the distinct values of each of ``keys``, to be kept: ``sketch``. Partial sketches of a task are merged, so a hot key shuffles no more than others. Nulls aren't counted."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, REGISTERS).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The estimated number of distinct values in the union of each key's sketches, as ``estimate``. Values in several are counted once."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def within_bound(estimate: Column, exact: Column) -> Column:
    """Whether an estimate is off by the stated bound at most: DEVIATIONS standard errors, or 1."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), DEVIATIONS * ERROR * exact)
