"""Operators over intervals and points on a timeline.

Times are integers or timestamps; intervals are half-open, [t0, t1). Every operator works inside the groups of ``keys``,
so a shuffle by those keys is all it needs; windows over the same keys and order share it. A window holds the rows of one
key in one task, sorted on disk if need be: add a stretch of time (a day, say) to ``keys`` where one key has too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType


def _known(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows without a null in ``columns``."""
    return rows.dropna(subset=[*columns])


def ticks(rows: DataFrame, at: str) -> Column:
    """The time ``at`` as a whole number: timestamps in microseconds, others as they are."""
    kind = rows.schema[at].dataType
    return F.unix_micros(F.col(at).cast("timestamp")) if isinstance(kind, TimestampType | TimestampNTZType) else F.col(at).cast("long")


def islands(points: DataFrame, keys: list[str], at: str, gap: Column, tie: str | None = None) -> DataFrame:
    """Runs of points of one key whose neighbours are at most ``gap`` apart.

    Returns the keys, ``island`` (0, 1, ... in time order), ``t0``, ``t1`` and ``n_events``. Both windows share one
    shuffle and one sort. Points at the same time fall in one island; a null time sorts first and joins the first one.
    """
    order = Window.partitionBy(*keys).orderBy(at, *([tie] if tie else []))
    fresh = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("long"), F.lit(0))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = points.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(running))
    return numbered.groupBy(*keys, "island").agg(F.min(at).alias("t0"), F.max(at).alias("t1"), F.count(F.lit(1)).alias("n_events"))


def gaps(points: DataFrame, keys: list[str], at: str, least: Column, tie: str | None = None) -> DataFrame:
    """Silences: the stretches longer than ``least`` between neighbouring points of a key, as keys, ``t0`` and ``t1``."""
    order = Window.partitionBy(*keys).orderBy(at, *([tie] if tie else []))
    return points.select(*keys, F.lag(at).over(order).alias("t0"), F.col(at).alias("t1")).where(F.col("t1") - F.col("t0") > least)


def merge(spans: DataFrame, keys: list[str], t0: str = "t0", t1: str = "t1") -> DataFrame:
    """The union of each key's intervals: overlapping and touching ones become one. Empty and null intervals are left out."""
    order = Window.partitionBy(*keys).orderBy(t0, t1)
    before = F.max(t1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(t0) <= before, 0).otherwise(1)
    numbered = spans.where(F.col(t0) < F.col(t1)).withColumn("__fresh", fresh)
    numbered = numbered.withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__run").agg(F.min(t0).alias(t0), F.max(t1).alias(t1)).drop("__run")


def complement(spans: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """What of each interval of ``whole`` (one for each key) lies in no interval of ``spans``; a key without spans is whole."""
    inside = merge(spans, keys).join(whole.select(*keys, F.col("t0").alias("__a"), F.col("t1").alias("__b")), keys)
    inside = inside.select(*keys, F.greatest("t0", "__a").alias("t0"), F.least("t1", "__b").alias("t1")).where("t0 < t1")
    first = whole.select(*keys, F.col("t0"), F.col("t0").alias("t1"), F.col("t1").alias("__end"))
    order = Window.partitionBy(*keys).orderBy("t0", "t1")
    rows = inside.withColumn("__end", F.lit(None).cast(first.schema["__end"].dataType)).unionByName(first)
    end = F.max("__end").over(Window.partitionBy(*keys))
    return rows.select(*keys, F.col("t1").alias("t0"), F.coalesce(F.lead("t0").over(order), end).alias("t1")).where("t0 < t1")


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The common parts of the intervals of ``a`` and ``b`` with equal keys. Each side is merged first, so parts are disjoint.

    The ends of both sides are swept in order with a running count of open intervals, so no interval is compared with another.
    """
    x, y = (_known(merge(side, keys), *keys) for side in (a, b))
    kind = x.schema["t0"].dataType
    ends = [side.select(*keys, F.col(at).cast(kind).alias("t0"), F.lit(d * (side is x)).alias("__x"), F.lit(d * (side is y)).alias("__y")) for side in (x, y) for at, d in (("t0", 1), ("t1", -1))]
    order = Window.partitionBy(*keys).orderBy("t0")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    swept = swept.select(*keys, "t0", F.lead("t0").over(order).alias("t1"), F.sum("__x").over(upto).alias("__x"), F.sum("__y").over(upto).alias("__y"))
    return swept.where("__x > 0 AND __y > 0 AND t0 < t1").select(*keys, "t0", "t1")


def not_contained(spans: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The intervals that no single interval of ``kept`` holds whole: what a cut has clipped. Intervals with nulls are held by none.

    Both are sorted together; an interval is held when one that began before it or with it ends as late, so the furthest end
    so far is all that needs to be known.
    """
    kind = spans.schema["t1"].dataType
    own = _known(kept, *keys, "t0", "t1").select(*[F.col(c) if c in {*keys, "t0"} else F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in spans.columns], F.col("t1").cast(kind).alias("__end"))
    both = spans.withColumn("__end", F.lit(None).cast(kind)).withColumn("__kept", F.lit(False)).unionByName(own.withColumn("__kept", F.lit(True)))
    order = Window.partitionBy(*keys).orderBy("t0", F.desc("__kept")).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__reach", F.max("__end").over(order))
    return swept.where(~F.col("__kept") & ~F.coalesce(F.col("__reach") >= F.col("t1"), F.lit(False))).drop("__end", "__kept", "__reach")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, label: str, *, after: bool = False) -> DataFrame:
    """Each point with ``value`` of the last mark of its key at or before it, as ``label``; null if there is none.

    ``after``: of the first mark at or after it. Points and marks are sorted together, so nothing but rows of one key is ever
    compared; no range join is needed.
    """
    kind = marks.schema[value].dataType
    both = points.withColumns({"__value": F.lit(None).cast(kind), "__mark": F.lit(0), "__at": F.col(at)})
    own = marks.select(*[F.col(c) if c in keys else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], F.col(value).alias("__value"), F.lit(1).alias("__mark"), F.col(at).alias("__at"))
    order = Window.partitionBy(*keys).orderBy(F.desc("__at") if after else F.asc("__at"), F.desc("__mark")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(own).withColumn(label, F.last("__value", ignorenulls=True).over(order))
    return out.where("__mark = 0").drop("__value", "__mark", "__at")


def snap(points: DataFrame, edges: DataFrame, keys: list[str], at: str, edge: str) -> DataFrame:
    """Each point with ``snapped``, the nearest edge of its key; the earlier of two that are as near, null without edges."""
    marks = edges.select(*keys, F.col(edge).alias(at), F.col(edge).alias("__edge")).dropna(subset=["__edge"])
    before = as_of(points, marks, keys, at, "__edge", "__before")
    both = as_of(before, marks, keys, at, "__edge", "__after", after=True)
    nearer = F.col("__before").isNotNull() & (F.col("__after").isNull() | (F.col(at) - F.col("__before") <= F.col("__after") - F.col(at)))
    return both.withColumn("snapped", F.when(nearer, F.col("__before")).otherwise(F.col("__after"))).drop("__before", "__after")


def content_range(spans: DataFrame, keys: list[str], t0: str = "t0", t1: str = "t1") -> DataFrame:
    """The first in point and the last out point of each key's content."""
    return spans.groupBy(*keys).agg(F.min(t0).alias("t_in"), F.max(t1).alias("t_out"))


def offsets(a: DataFrame, b: DataFrame, keys: list[str], at: str, reach: int) -> DataFrame:
    """For each key the shift of ``b`` against ``a`` that most pairs of events agree on, up to ``reach``; ties go to the least.

    Timestamps are shifted by microseconds, and ``reach`` counts those. Both sides are put into bins of ``reach`` and met in
    their own and the neighbouring ones, so the join has an equal key.
    """
    x = a.select(*keys, ticks(a, at).alias("__x")).withColumn("__bin", F.floor(F.col("__x") / reach))
    y = b.select(*keys, ticks(b, at).alias("__y")).withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__y") / reach) + d for d in (-1, 0, 1)])))
    shifts = x.join(y, [*keys, "__bin"]).withColumn("offset", F.col("__y") - F.col("__x")).where(F.abs("offset") <= reach)
    votes = shifts.groupBy(*keys, "offset").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("votes", -F.abs("offset"), -F.col("offset"), "offset")).alias("m"))
    return best.select(*keys, F.col("m.offset").alias("offset"), F.col("m.votes").alias("votes"))


#: A bin has FAN bins of the level below it; from level COARSE on, points meet bins by the bin that they share at that level.
FAN, COARSE = 8, 5


def _whole_bins(t0: Column, t1: Column, top: int) -> Column:
    """The bins that lie in [t0, t1) whole and in no larger such bin, as structs of level and bin: at most 2 (FAN - 1) a level."""

    def run(a: Column, z: Column, level: int) -> Column:
        return F.when(a < z, F.transform(F.sequence(a, z - 1), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

    def ends(level: int) -> tuple[Column, Column]:
        return (-F.floor(-t0 / FAN**level)).cast("long"), F.floor(t1 / FAN**level).cast("long")

    found = []
    for level in range(top + 1):
        (a, z), (pa, pz) = ends(level), ends(level + 1)
        if level == top:
            found.append(run(a, z, level))
        else:
            inside = pa < pz
            found += [run(a, F.when(inside, pa * FAN).otherwise(z), level), F.when(inside, run(pz * FAN, z, level)).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))]
    return F.concat(*found)


def least_over(points: DataFrame, spans: DataFrame, keys: list[str], at: str, value: str, label: str, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Each point with ``label``, the least ``value`` of the intervals of its key that hold it; null where none does.

    No interval is compared with a point. Intervals are cut into bins of FAN^0, FAN^1, ... ticks, a few for each level, and the
    least value of a bin is kept; a point is held by what its own bin of some level has. Levels reach to the longest interval.
    Bins, not keys, are what rows are dealt by, so many tasks share a key that has most rows. Above level COARSE only the
    distinct bins of that level ask, so one large bin is no task's burden. Work is in proportion to points and intervals, times
    the levels. Null times, keys or values hold nothing, and points of a null time or key are held by nothing.
    """
    longest = _known(spans, *keys, t0, t1, value).agg(F.max(ticks(spans, t1) - ticks(spans, t0))).first()[0]
    if longest is None or longest <= 0:
        return points.withColumn(label, F.lit(None).cast(spans.schema[value].dataType))
    top = 0
    while FAN ** (top + 1) <= longest:
        top += 1
    own = _known(spans, *keys, t0, t1, value).select(*keys, ticks(spans, t0).alias("__t0"), ticks(spans, t1).alias("__t1"), F.col(value).alias("__v"))
    bins = own.select(*keys, "__v", F.explode(_whole_bins(F.col("__t0"), F.col("__t1"), top)).alias("__b")).select(*keys, "__b.level", "__b.bin", "__v")
    bins = bins.groupBy(*keys, "level", "bin").agg(F.min("__v").alias("__v"))
    times = _known(points.select(*keys, ticks(points, at).alias("__t")), *keys, "__t").distinct()

    def met(asking: DataFrame, by: str, levels: range, width: int) -> DataFrame:
        """The least value of the bins of ``levels`` that hold ``by``, a bin of ``width`` ticks, for each row of ``asking``."""
        each = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col(by) / (FAN**n // width)).cast("long").alias("bin")) for n in levels])
        held = asking.select(*keys, by, F.explode(each).alias("__b")).select(*keys, by, "__b.level", "__b.bin").join(bins, [*keys, "level", "bin"])
        return held.groupBy(*keys, by).agg(F.min("__v").alias("__v"))

    out = points.withColumn("__t", ticks(points, at))
    found = met(times, "__t", range(min(top + 1, COARSE)), 1).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__t").alias("__kt"), F.col("__v").alias("__fine"))
    same = lambda right: [out[k] == right[f"__k{i}"] for i, k in enumerate(keys)]
    out = out.join(found, [*same(found), out["__t"] == found["__kt"]], "left").drop(*found.columns[:-1])
    least = F.col("__fine")
    if top >= COARSE:
        bin_of = F.floor(F.col("__t") / FAN**COARSE).cast("long")
        wide = met(times.select(*keys, bin_of.alias("__w")).distinct(), "__w", range(COARSE, top + 1), FAN**COARSE)
        wide = wide.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__w").alias("__kw"), F.col("__v").alias("__coarse"))
        out = out.withColumn("__w", bin_of)
        out = out.join(wide, [*same(wide), out["__w"] == wide["__kw"]], "left").drop(*wide.columns[:-1], "__w")
        least = F.least("__fine", "__coarse")
    return out.withColumn(label, least).drop("__t", "__fine", "__coarse")


def gain_at(points: DataFrame, curves: DataFrame, keys: list[str], at: str, default: float = 1.0) -> DataFrame:
    """Each point with ``gain``, the least of the gains of the curves' intervals that hold it: how far a bed is ducked."""
    return least_over(points, curves, keys, at, "gain", "gain").withColumn("gain", F.coalesce("gain", F.lit(default)))


def turned(beds: DataFrame, lines: DataFrame, keys: list[str], turn: str, at: str) -> DataFrame:
    """Each bed with ``offset``: how far it moves so that its ``turn`` falls on the time ``at`` of its key's line; null without a line."""
    own = lines.select(*keys, F.col(at).alias("__line"))
    return beds.join(own, keys, "left").withColumn("offset", F.col("__line") - F.col(turn)).drop("__line")


def correlated(a: DataFrame, b: DataFrame, keys: list[str], at: str, width: int, reach: int) -> DataFrame:
    """For each key the shift of ``b`` against ``a`` at which both are most alike, borne by jitter of about ``width``.

    Points of both are counted in bins of ``width`` ticks (microseconds for timestamps) and smoothed over the neighbouring bins
    by 1, 2, 1. The cross-correlation of the two signals is taken for all shifts of whole bins up to ``reach`` bins. Returns
    ``offset`` (the shift in ticks; of equal ones the shortest, then the lower), ``likeness`` (0 to 1: the correlation over the product of both
    signals' lengths) and ``margin``, how far the best correlation of a shift more than two bins away falls short of it, as a
    share of it: near 0, the shift is in doubt. A key that has points on one side only, or none within reach, has no row.

    Counts meet before they are smoothed: smoothing both signals is the same as smoothing their correlation over the shifts by 1, 4,
    6, 4, 1. Occupied bins of both sides meet by stretches of time, so a key that has most points is shared by many tasks; rows
    grow with occupied bins times the shifts that are found there. Many points in one bin are one number.
    """
    far = reach + 2

    def counted(side: DataFrame) -> DataFrame:
        bins = side.select(*keys, F.floor(ticks(side, at) / width).cast("long").alias("__bin"))
        return _known(bins, *keys, "__bin").groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))

    def spread(rows: DataFrame, by: str, count: str, weights: list[int]) -> DataFrame:
        half = len(weights) // 2
        each = F.explode(F.array(*[F.struct(F.lit(k - half).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)]))
        out = rows.withColumn("__s", each).select(*keys, (F.col(by) + F.col("__s.d")).alias(by), (F.col(count) * F.col("__s.w")).alias(count))
        return out.groupBy(*keys, by).agg(F.sum(count).alias(count))

    x, y = counted(a), counted(b)
    near = x.withColumn("__stretch", F.floor(F.col("__bin") / far))
    other = y.select(*keys, F.col("__bin").alias("__to"), F.col("__n").alias("__m"), F.explode(F.array(*[F.floor(F.col("__bin") / far) + d for d in (-1, 0, 1)])).alias("__stretch"))
    raw = near.join(other, [*keys, "__stretch"]).where(F.abs(F.col("__to") - F.col("__bin")) <= far)
    raw = raw.groupBy(*keys, (F.col("__to") - F.col("__bin")).alias("__lag")).agg(F.sum(F.col("__n") * F.col("__m")).alias("__c"))
    found = spread(raw, "__lag", "__c", [1, 4, 6, 4, 1]).where(F.abs("__lag") <= reach)
    lists = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("__c")).alias("c"), F.abs("__lag").alias("far"), F.col("__lag").alias("lag")))).alias("__all"))
    size = lambda side, name: spread(side, "__bin", "__n", [1, 2, 1]).groupBy(*keys).agg(F.sqrt(F.sum(F.col("__n") * F.col("__n"))).alias(name))
    best = F.get("__all", 0)
    second = F.get(F.filter("__all", lambda s: F.abs(s["lag"] - F.get(F.col("__all"), 0)["lag"]) > 2), 0)
    own = lists.join(size(x, "__x"), keys).join(size(y, "__y"), keys)
    return own.select(*keys, (best["lag"] * width).cast("long").alias("offset"), (-best["c"] / (F.col("__x") * F.col("__y"))).alias("likeness"), (1 - F.coalesce(second["c"], F.lit(0)) / best["c"]).alias("margin"))
