"""Repeated runs of lines removed across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, let, row_hash, split_listed, words

#: One line in DIVISOR ends a chunk, and a chunk has at most LONGEST lines; a line of LONG_WORDS words is a chunk by itself.
DIVISOR, LONGEST, LONG_WORDS = 4, 16, 50


def _pieces(lines: Column, counts: Column) -> Column:
    """(start, length) of each chunk of ``lines``, and of its heads and tails of two lines and more. ``counts``: words of each line.

    The hash of a line and the one before it (a rolling hash over a window of two line hashes) decides whether the line
    ends a chunk, so boundaries depend on what stands at them, not on their place. A passage is cut at the same places
    wherever it stands; its first and last part are a tail and a head of the chunks that they share with their
    surroundings.
    """
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))

    def ends(h: Column) -> Column:
        rolled = lambda i: (F.get(h, i) * 31 + F.when(i > 0, F.get(h, i - 1)).otherwise(0)) % 1_000_003 % DIVISOR == 0
        alone = lambda i: (F.get(counts, i) >= LONG_WORDS) | F.coalesce(F.get(counts, i + 1) >= LONG_WORDS, F.lit(False))
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == F.size(h) - 1) | rolled(i) | alone(i))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), (end - start + 1).cast("int").alias("length"))

    def chunks(e: Column) -> Column:
        natural = F.transform(e, lambda x, k: F.struct(F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0).alias("a"), x.alias("b")))
        return F.flatten(F.transform(natural, lambda c: F.transform(F.sequence(c["a"], c["b"], F.lit(LONGEST)), lambda s: F.struct(s.alias("a"), F.least(s + LONGEST - 1, c["b"]).alias("b")))))

    def parts(c: Column) -> Column:
        whole = F.array(span(c["a"], c["b"]))
        heads = F.transform(F.sequence(c["a"] + 1, c["b"] - 1), lambda b: span(c["a"], b))
        tails = F.transform(F.sequence(c["a"] + 1, c["b"] - 1), lambda a: span(a, c["b"]))
        return F.when(c["b"] - c["a"] < 2, whole).otherwise(F.concat(whole, heads, tails))

    return let(hashes, lambda h: let(ends(h), lambda e: F.flatten(F.transform(chunks(e), parts))))


def _windows(counts: Column) -> Column:
    """(start, length) of the shortest run of two lines and LONG_WORDS words from each line on, and up to each line.

    Lines without words neither begin nor end a run nor count as lines. A run of two lines and LONG_WORDS words, wherever it
    stands, holds the windows from its first lines on and the one up to its last line, and these together hold all its lines.
    """

    def reach(ws: Column, k: Column) -> Column:
        """Lines from ``k`` on until there are enough; null if there never are."""
        more = lambda a, x: F.when((a["words"] >= LONG_WORDS) & (a["lines"] >= 2), a).otherwise(F.struct((a["words"] + x).alias("words"), (a["lines"] + 1).alias("lines")))
        within = lambda most: F.aggregate(F.slice(ws, k + 1, F.lit(most)), F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")), more, lambda a: F.when((a["words"] >= LONG_WORDS) & (a["lines"] >= 2), a["lines"]))
        return F.coalesce(within(8), within(LONG_WORDS))

    def of(at: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(at) - 1)
        reaches = lambda ws: F.transform(each, lambda k: reach(ws, k))
        span = lambda a, b: F.struct(F.get(at, a).cast("int").alias("start"), (F.get(at, b) - F.get(at, a) + 1).cast("int").alias("length"))
        ws = F.transform(at, lambda i: F.get(counts, i))

        def both(ahead: Column, back: Column) -> Column:
            last = F.size(at) - 1
            froms = F.transform(F.filter(each, lambda k: F.get(ahead, k).isNotNull()), lambda k: span(k, k + F.get(ahead, k) - 1))
            first = lambda k: k - F.get(back, last - k) + 1
            new = F.filter(each, lambda k: F.get(back, last - k).isNotNull() & ~F.coalesce(F.get(ahead, first(k)) == F.get(back, last - k), F.lit(False)))
            return F.concat(froms, F.transform(new, lambda k: span(first(k), k)))

        return let(reaches(ws), lambda ahead: let(reaches(F.reverse(ws)), lambda back: both(ahead, back)))

    worded = F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) > 0)
    enough = F.aggregate(counts, F.lit(0), lambda a, x: a + x) >= LONG_WORDS
    return let(F.when(enough, worded), lambda at: F.when(F.size(at) >= 2, of(at)).otherwise(F.array().cast("array<struct<start:int,length:int>>")))


def _piece_text(lines: Column, p: Column) -> Column:
    return F.array_join(F.slice(lines, p["start"] + 1, p["length"]), "\n")


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", drop_emptied: bool = False, windows: bool = True) -> DataFrame:
    """``docs`` without the lines that stand in a repeated multi-line chunk, and with ``n_lines_removed``.

    Chunks, their heads and their tails (see ``_pieces``) of two lines and more, and single lines of LONG_WORDS words and
    more, are counted over all documents; with ``windows`` also those of ``_windows``, so that of every repeated run of two
    lines and LONG_WORDS words all lines from its first to its last with words are found. Without, a run is missed where
    boundaries leave single lines or none falls in it. Of those with the same bytes the first by ``key`` and place stays; the lines of all
    others go. Every line that goes has an equal line before it, so each distinct line stays somewhere. ``drop_emptied``
    leaves out documents of which nothing but blank lines is left although they had more.

    Only hashes are shuffled for all pieces. Their text is taken where a hash came twice, and grouped by its bytes; whether a
    piece is the first is decided by an anti-join on its own place, and hashes are joined where the engine splits hot ones, so
    neither a hot hash nor a hot text gathers in a task. Only documents with a listed piece, and few others (see
    ``split_listed``), are shuffled to meet their list.

    Null and empty texts stay as they are. Null or repeated keys are told apart by text, rows equal in both are alike and
    don't count as repeats of each other. An empty table gives an empty result. Other columns are passed on; names that
    begin with __tm_ are reserved.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    place = ["__tm_key", "__tm_row", "start", "length"]
    own = docs.where(F.col(text) != "").select(F.col(key).alias("__tm_key"), row_hash(key, text).alias("__tm_row"), F.split(text, "\n").alias("__tm_lines"))

    def listed_spans(n: Column) -> Column:
        large = F.filter(_pieces(F.col("__tm_lines"), n), lambda p: (p["length"] >= 2) | (F.get(n, p["start"]) >= LONG_WORDS))
        if not windows:
            return large
        # What begins and ends with words and has enough is made of windows.
        made = lambda p: (p["length"] >= 2) & (F.get(n, p["start"]) > 0) & (F.get(n, p["start"] + p["length"] - 1) > 0) & (F.aggregate(F.slice(n, p["start"] + 1, p["length"]), F.lit(0), lambda a, x: a + x) >= LONG_WORDS)
        return F.concat(F.filter(large, lambda p: ~made(p)), _windows(n))

    spans = let(F.transform("__tm_lines", lambda x: F.size(words(x))), listed_spans)
    hashed = F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), F.xxhash64(_piece_text(F.col("__tm_lines"), p)).alias("h")))
    pieces = scratch.keep("pieces", own.select("__tm_key", "__tm_row", F.explode(hashed).alias("p")).select("__tm_key", "__tm_row", "p.*"))

    repeated = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = scratch.keep("again", pieces.join(repeated, "h", "left_semi").select(*place))
    scratch.drop("pieces")
    listed = F.collect_list(F.struct("start", "length")).alias("__tm_spans")

    def meet(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
        right = spans.groupBy("__tm_key", "__tm_row").agg(listed).select(F.col("__tm_key").alias("__tm_g_key"), F.col("__tm_row").alias("__tm_g_row"), "__tm_spans")
        may, rest = split_listed(rows, rows["__tm_row"], spans, "__tm_row")
        met = may.join(right, may["__tm_key"].eqNullSafe(right["__tm_g_key"]) & (may["__tm_row"] == right["__tm_g_row"]), how)
        return met if how == "inner" else met.unionByName(rest, allowMissingColumns=True)

    texts = meet(own, again, "inner").select("__tm_key", "__tm_row", F.explode(F.transform("__tm_spans", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), _piece_text(F.col("__tm_lines"), p).alias("bytes")))).alias("p"))
    kept = texts.select("__tm_key", "__tm_row", "p.*").groupBy("bytes").agg(F.min(F.struct(*place)).alias("first")).select("first.*")
    right = kept.select(*[F.col(c).alias(f"__tm_g_{c}") for c in place])
    gone = scratch.keep("gone", again.join(right, [again[c].eqNullSafe(right[f"__tm_g_{c}"]) for c in place], "left_anti"))
    scratch.drop("again")

    rows = docs.withColumns({"__tm_key": F.col(key), "__tm_row": row_hash(key, text)})
    lines = F.split(text, "\n")
    covered = lambda i: F.exists(F.col("__tm_spans"), lambda p: (p["start"] <= i) & (i < p["start"] + p["length"]))
    left = F.filter(lines, lambda x, i: ~covered(i))
    out = meet(rows, gone, "left").withColumn("__tm_left", F.when(F.col("__tm_spans").isNotNull(), left))
    out = out.withColumn("n_lines_removed", F.when(F.col("__tm_left").isNotNull(), F.size(lines) - F.size("__tm_left")).otherwise(0).cast("long"))
    out = out.withColumn("__tm_new", F.when(F.col("__tm_left").isNotNull(), F.array_join("__tm_left", "\n")).otherwise(F.col(text)))
    if drop_emptied:
        out = out.where((F.col("n_lines_removed") == 0) | F.col("__tm_new").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("__tm_new").alias(c) if c == text else F.col(c) for c in docs.columns if c != "n_lines_removed"], "n_lines_removed")
