"""Token counts of whole texts, without the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, frugal
from tidemark.llm.fragments import PieceCounter, loaded


def count_tokens(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096, batch_bytes: int = 4 << 20) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit) for each row of ``docs``.

    A narrow pass: no shuffle, only lengths leave the Arrow function. Inside a task, texts meet the library in batches of
    about ``batch_bytes``, so one batch of long texts takes no more memory than one of short texts; long texts are cut at
    boundaries that no token crosses (see PieceCounter), and a fragment that came before isn't encoded again. A long text
    without a space is one fragment.

    Null text counts as empty: 0 bytes, 0 tokens. Null or repeated keys each give a row of their own. An empty table gives
    an empty result. Only ``key`` and ``text`` are read, so other columns can have any name.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(PieceCounter, model)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            rows = zip(b.column(1).to_pylist(), sizes.to_pylist(), strict=True)
            counts = [n for part in by_bytes(rows, lambda r: r[1], batch_bytes) for n in counter.counts([t or "" for t, _ in part])]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])
        counter.memo.known.clear()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(frugal(run), schema)
