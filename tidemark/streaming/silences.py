"""Islands and silences of a stream, with keyed state that lasts as long as an island may still grow."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

#: What a bucket's state holds for each of its keys: the key, the number of its next island, the end of the one before (null before
#: the first), how far silences have been told, and the islands that may still change, in order.
STATE = "ids array<string>, next array<bigint>, ended array<bigint>, told array<bigint>, t0s array<array<bigint>>, t1s array<array<bigint>>, ns array<array<bigint>>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are JSON texts in a bucket, whatever their types; times in them keep their microseconds.
WRITTEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
NAMES = ["id", "kind", "island", "t0", "t1", "n_events"]
TOLD = "id string, kind string, island long, t0 long, t1 long, n_events long"


def grown(spans: list[list[int]], at: int, gap: int, n: int = 1, until: int | None = None) -> None:
    """Puts a point, or ``n`` of them from ``at`` to ``until``, into ``spans``, sorted [t0, t1, n] that are more than ``gap`` apart; those that it brings together become one."""
    i = bisect_left(spans, at - gap, key=lambda s: s[1])
    j = i
    new = [at, at if until is None else until, n]
    while j < len(spans) and spans[j][0] <= new[1] + gap:
        new = [min(new[0], spans[j][0]), max(new[1], spans[j][1]), new[2] + spans[j][2]]
        j += 1
    spans[i:j] = [new]


class Silences(StatefulProcessor):
    """Islands of each key as they end, and the silence before an island once nothing can come before it.

    Input rows hold (bucket, id, time, micros): a key's JSON text, its bucket, and the time in microseconds as a number. Rows of a
    batch only enlarge islands; a timer, which fires after all of a batch's rows, gives out what the watermark has passed. So the
    order of rows inside a batch doesn't matter, nor that of rows which the watermark still lets through. State and timers are
    asked for by bucket, since each question is a message between Python and the JVM.
    """

    def __init__(self, gap: int, forget: int | None):
        self.gap, self.forget = gap, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("islands", STATE)

    def _load(self) -> dict[str, list]:
        """[next, ended, told, spans] of each key."""
        held = self.state.get()
        if held is None:
            return {}
        return {id: [number, ended, told, [list(s) for s in zip(*spans, strict=True)]] for id, number, ended, told, *spans in zip(*held, strict=True)}

    def _waits(self, ended: int | None, told: int | None, spans: list[list[int]]) -> int | None:
        """The next time at which there is something to tell of a key, or to forget."""
        if not spans:
            return None if self.forget is None or ended is None else ended + self.forget
        due = spans[0][1] + self.gap
        return min(due, spans[0][0]) if ended is not None and (told is None or told < spans[0][0]) else due

    def _save(self, keys: dict[str, list]) -> None:
        """Writes the state, and sets one timer, for the key that has something to tell first."""
        if keys:
            number, ended, told, spans = zip(*keys.values(), strict=True)
            self.state.update((list(keys), list(number), list(ended), list(told), *([[s[i] for s in own] for own in spans] for i in range(3))))
        else:
            self.state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waits = [w for _, *key in keys.values() if (w := self._waits(*key)) is not None]
        if waits:
            self.handle.registerTimer(min(waits) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        keys = self._load()
        for frame in rows:
            codes, ids = pd.factorize(frame["id"])
            micros = frame["micros"].to_numpy()
            order = np.lexsort((micros, codes))
            codes, micros = codes[order], micros[order]
            begins = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(micros, prepend=micros[:1]) > self.gap))
            ends = np.append(begins[1:], len(micros))
            held = [keys.setdefault(id, [0, None, None, []])[3] for id in ids]
            for code, t0, t1, n in zip(codes[begins].tolist(), micros[begins].tolist(), micros[ends - 1].tolist(), (ends - begins).tolist(), strict=True):
                grown(held[code], t0, self.gap, n, t1)
        self._save(keys)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # no row before this time can still come
        keys, out = self._load(), []
        for id, own in list(keys.items()):
            number, ended, told, spans = own
            done = 0
            for t0, t1, n in spans:
                if ended is not None and (told is None or told < t0) and t0 < passed:
                    out.append((id, "silence", number, ended, t0, None))
                    told = t0
                if t1 + self.gap >= passed:
                    break
                out.append((id, "island", number, t0, t1, n))
                number, ended, done = number + 1, t1, done + 1
            if done == len(spans) and self.forget is not None and ended is not None and ended + self.forget < passed:
                del keys[id]
            else:
                own[:] = number, ended, told, spans[done:]
        self._save(keys)
        if out:
            yield pd.DataFrame(out, columns=NAMES, dtype=object)

    def close(self) -> None:
        pass


def silence_stream(events: DataFrame, keys: list[str], at: str, gap_seconds: float, late: str, forget_seconds: float | None = None, buckets: int = 4096) -> DataFrame:
    """The islands and silences of a stream of points: runs whose neighbours are at most ``gap_seconds`` apart, and what lies between.

    Returns the keys, ``kind`` ("island" or "silence"), ``island`` (the number of the island, or of the one after the silence),
    ``t0``, ``t1`` and, for islands, ``n_events``. Each is told once, in append mode: an island when the watermark, which
    follows ``late`` behind, has passed its end by more than the gap; a silence when the watermark has passed the point that ends
    it. Rows behind the watermark are left out by the engine, as are null times; what is still open when the stream stops is
    told by a later run from the same checkpoint. All other rows give the islands and silences of the batch operators.

    A key's state is its unfinished islands, at most ``late`` / gap and two more, whatever its number of points; of a key that
    has nothing unfinished two numbers stay. With ``forget_seconds`` they go as well, that long after its last point: a key that
    then comes back begins with island 0 and no silence before it. Keys are dealt into ``buckets`` by their hash, and the state of
    a bucket is read and written as one: take so many that a bucket has some hundreds of keys at most, and keep the number while a
    checkpoint lasts. The session needs the RocksDB state store (PROVIDER). Times must lie in pandas' range, from 1678 to 2262.
    """
    own = events.withColumn(at, F.col(at).cast("timestamp")).dropna(subset=[at]).withWatermark(at, late)
    processor = Silences(round(gap_seconds * 1_000_000), None if forget_seconds is None else round(forget_seconds * 1_000_000))
    points = own.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*keys), WRITTEN).alias("id"), at, F.unix_micros(at).alias("micros"))
    told = points.groupBy("bucket").transformWithStateInPandas(processor, TOLD, "append", "eventTime")
    read = F.from_json("id", StructType([events.schema[k] for k in keys]), WRITTEN)
    return told.select(read.alias("id"), "kind", "island", F.timestamp_micros("t0").alias("t0"), F.timestamp_micros("t1").alias("t1"), "n_events").select("id.*", "kind", "island", "t0", "t1", "n_events")
