"""Event density over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def density(events: DataFrame, at: str, width: str, late: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts of events for each window of ``width`` and each of ``keys``; batch or streaming.

    On a stream ``late`` is the watermark's delay: a window is emitted once it has passed, and what comes later is left out.
    """
    own = events.withColumn(at, F.col(at).cast("timestamp"))
    own = own.withWatermark(at, late) if late else own
    counts = own.groupBy(F.window(at, width), *(keys or [])).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select(F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), *(keys or []), "n_events")
