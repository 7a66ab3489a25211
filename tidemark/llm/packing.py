"""Packing of tokenized documents into fixed windows with bounded space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, by_bytes, frugal, small_batches
from tidemark.llm.fragments import ByteEncoder, loaded

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence numbers of one task or merging group; ids of merged sequences begin at MERGED.
PER_TASK, MERGED = 1 << 32, 1 << 62
#: Rows of a batch whose texts are held apart from it at a time.
ROWS = 500


class OpenWindows:
    """At most ``space`` partly filled windows. Pieces are (doc index, start, ids, doc tokens)."""

    def __init__(self, size: int, space: int, slack: int):
        self.size, self.space, self.slack, self.open = size, space, slack, []

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Puts a piece where the least room stays; yields the windows that this closes.

        When it fits nowhere and no window may be opened, the fullest is emitted: as it is if at most ``slack`` tokens are
        missing, else topped up with the head of the piece.
        """
        while True:
            n = len(piece[2]) // 4
            if n >= self.size:
                head, piece = self.cut(piece, self.size)
                yield [head]
                if piece is None:
                    return
                continue
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[0] += n
                best[1].append(piece)
                if best[0] == self.size:
                    self.open.remove(best)
                    yield best[1]
                return
            if len(self.open) < self.space:
                self.open.append([n, [piece]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            if self.size - fullest[0] > self.slack:
                head, piece = self.cut(piece, self.size - fullest[0])
                fullest[1].append(head)
            yield fullest[1]

    def merge(self) -> Iterator[list[tuple]]:
        """Closes all windows: their pieces fill windows one after another, and only the last can stay short."""
        held, total = [], 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for piece in pieces:
                while piece is not None:
                    head, piece = self.cut(piece, self.size - total)
                    held.append(head)
                    total += len(head[2]) // 4
                    if total == self.size:
                        yield held
                        held, total = [], 0
        self.open = []
        if held:
            yield held

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
        doc, start, ids, total = piece
        return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total) if len(ids) > 4 * n else None


def _rows(window: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window:
        yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset
        offset += len(ids) // 4


def pack(
    docs: DataFrame, vocabulary: str, ranks: str, pattern: str, *, end_id: int = 1, key: str = "doc_id", text: str = "text",
    size: int = 2048, space: int = 32, slack: int = 8, merged: int = 64, batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Pieces of the token ids of ``docs`` in sequences of ``size``: ``key`` and the columns of PIECE.

    A document's ids are those of its text and then ``end_id``. Every id lies in exactly one piece; a sequence's pieces lie
    side by side from offset 0. Each task packs its own documents as they come, holding at most ``space`` open windows
    (see OpenWindows), so its memory doesn't grow with its input, and closes them at its end. What is then left of a task is
    less than one window; ``merged`` tasks' leftovers are joined at a time, so one short sequence stays for ``merged`` tasks.

    One pass over the texts, without a shuffle of them. The pieces are written to the shared folder, since the leftovers
    need them a second time: a lost executor costs the tasks it ran, and numbers depend only on a task's place.

    Null text is empty (its only id is ``end_id``). Null or repeated keys are packed as rows of their own. An empty table
    gives an empty result. Only ``key`` and ``text`` are read. A very long text is encoded and cut into windows as a whole, in
    the worker that has it; texts reach workers in batches of about ``batch_bytes``.
    """
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(f"`{key}`")).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(ByteEncoder, vocabulary, ranks, pattern)
        windows, end = OpenWindows(size, space, slack), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() * PER_TASK
        # A batch is taken apart in slices, so that few of its texts stand beside it.
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            keys, out = b.column(0), []
            at = 0
            for part in by_bytes((t or "" for t in b.column(1).to_pylist()), len, batch_bytes):
                for ids in encoder.encode(part):
                    ids += end
                    for window in windows.place((keys[at], 0, ids, len(ids) // 4)):
                        out += _rows(window, sequence)
                        sequence += 1
                    at += 1
            yield table(out, None)
        for window in windows.merge():
            short = sum(len(p[2]) for p in window) < 4 * size
            yield table(list(_rows(window, sequence)), [p[2] for p in window] if short else None)
            sequence += 1
        encoder.memo.known.clear()

    def table(rows: list[tuple], left: list[bytes] | None) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        keys = pa.array([k.as_py() for k in columns[0]], keyed)
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(left or [None] * len(rows), pa.binary())], names)

    names = [key, *(c.split()[0] for c in PIECE.split(", ")), "ids"]

    def join(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        windows = OpenWindows(size, 0, 0)
        rows = rows.sort_values(["sequence_id", "offset"])
        windows.open = [[0, [(k, s, bytes(i), n)]] for k, s, i, n in zip(rows[key], rows["start"], rows["ids"], rows["doc_tokens"], strict=True)]
        out = [r for i, w in enumerate(windows.merge()) for r in _rows(w, MERGED + int(group[0]) * PER_TASK + i)]
        return pd.DataFrame(out, columns=names[:-1])

    with small_batches(docs.sparkSession, batch_bytes):
        pieces = Scratch(docs.sparkSession, "packing").keep("pieces", docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(frugal(run), f"`{key}` {kind}, {PIECE}, ids binary"))
    left = pieces.where("ids IS NOT NULL").withColumn("__group", F.floor(F.col("sequence_id") / (PER_TASK * merged)).cast("long"))
    return pieces.where("ids IS NULL").drop("ids").unionByName(left.groupBy("__group").applyInPandas(join, f"`{key}` {kind}, {PIECE}"))
