"""Documents linked by the Jaccard similarity of their word shingles, by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, anti_listed, bounded, frugal
from tidemark.llm.components import components
from tidemark.llm.hashing import shingle_sets

#: Bounds: frequent shingles that are sent to every task, shingles counted at a time in a task, documents of a hot shingle
#: that meet in one task, slots of the filter of candidate documents, members of a group's block and queries met by it at a time.
FREQUENT, COUNTED, TOGETHER, SLOTS, MEMBERS, QUERIES = 1 << 18, 2_000_000, 4096, 1 << 22, 64, 512
#: Ids of at most so many documents are broadcast.
LABEL_ROWS = 2_000_000


#: Rows of a batch whose texts are held apart from it at a time.
ROWS = 1000


def _set_of_each(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for at in range(0, b.num_rows, ROWS):
        yield from shingle_sets(b.column(1).slice(at, ROWS).cast(pa.binary()).to_pylist())


def bitmap(s: np.ndarray) -> bytes:
    """A bit for the lowest bits of each hash, four bits or more for each and a power of two in all."""
    bits = np.zeros(1 << max(8, int(4 * len(s) - 1).bit_length()), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def resized(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes that has every bit that its documents' shingles can have there."""
    if size <= len(bits):
        return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)
    return np.tile(bits, size // len(bits))


def within(bits: np.ndarray, n: int, other: np.ndarray) -> int:
    """At least so many of n shingles lie outside of ``other``; the rest is the most that both can share."""
    return n - int(np.bitwise_count(bits & ~resized(other, len(bits))).sum())


def _required(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    x = xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (key, size, 128-bit digest and bitmap of its set), and one for each shingle found in two sets of a task or more."""
    held: list[np.ndarray] = []
    digests: set[tuple[int, int]] = set()
    total = 0

    def rows(keys: pa.Array, n: list, keyed: list, bits: list, tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        m = len(tokens)
        one = lambda own, kind=pa.int64(): pa.array([*own, *[None] * m], kind)
        two = lambda own: pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(own, pa.int64())])
        keys = pa.concat_arrays([keys, pa.nulls(m, keys.type)])
        return pa.RecordBatch.from_arrays([keys, one(n), one([k[0] for k in keyed]), one([k[1] for k in keyed]), one(bits, pa.binary()), two(tokens.view(np.int64)), two(counts)], ["key", "n", "k1", "k2", "bits", "token", "count"])

    def frequent() -> tuple[np.ndarray, np.ndarray]:
        tokens, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        held.clear()
        digests.clear()
        return tokens[counts > 1], counts[counts > 1]

    kind = None
    for b in batches:
        n, keyed, bits = [], [], []
        kind = b.column(0).type
        for s in _set_of_each(b):
            n.append(len(s))
            keyed.append(k := _set_key(s))
            bits.append(bitmap(s))
            if k not in digests:
                digests.add(k)
                held.append(s)
                total += len(s)
        tokens, counts = frequent() if total >= COUNTED else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        total = 0 if total >= COUNTED else total
        yield rows(b.column(0), n, keyed, bits, tokens, counts)
    if held:
        tokens, counts = frequent()
        yield rows(pa.nulls(0, kind), [], [], [], tokens, counts)


def _prefixes(frequent, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n, k1, k2, common, prefix, salts) of each document. A hot shingle's documents are dealt to salts from 1 on; 0: not hot."""
        tokens, ranks = frequent.value
        for b in batches:
            n, keyed, prefixes, salts, common = [], [], [], [], []
            for s in _set_of_each(b):
                n.append(len(s))
                keyed.append(k := _set_key(s))
                take = len(s) - _required(len(s), percent) + 1 if len(s) else 0
                common.append(0)
                rank = np.zeros(len(s), np.int64)
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, ranks[at], 0)
                    common[-1] = int(1000 * np.count_nonzero(rank) / len(s))
                    order = np.argsort(rank, kind="stable")[:take]
                    s, rank = s[order], rank[order]
                prefixes.append(s[:take].view(np.int64))
                rank = rank[:take]
                salts.append(np.where(rank > TOGETHER, 1 + k[0] % (1 + rank // TOGETHER), 0).astype(np.int32))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([*x, np.zeros(0, kind)])) for x, kind in ((prefixes, np.int64), (salts, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array([k[i] for k in keyed], pa.int64()) for i in (0, 1)), pa.array(common, pa.int64()), *lists], ["key", "n", "k1", "k2", "common", "prefix", "salts"])

    return run


def _sets(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = slots.value
        for b in batches:
            hit = np.flatnonzero(wanted[b.column(2).to_numpy()])
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            sets = [s.view(np.int64) for s in _set_of_each(b)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc", "tokens"])

    return run


def _similar(i: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * i >= percent * (F.size(a) + F.size(b) - i)


def _may_link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, b) whose bitmaps don't rule out that they are similar."""
        for b in batches:
            na, nb, bits_a, bits_b = (b.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            keep = [_fit(n, np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8), percent) for n, x, m, y in zip(na, bits_a, nb, bits_b, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fit(n: int, x: np.ndarray, m: int, y: np.ndarray, percent: int) -> bool:
    need = -(-percent * (n + m) // (100 + percent))
    return min(n, m) >= need and within(x, n, y) >= need and within(y, m, x) >= need


def _verified(scratch: Scratch, name: str, pairs: DataFrame, own: DataFrame, kind: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets are made for the documents of pairs only, which a filter of SLOTS bits tells."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    used = pairs.select(F.explode(F.array("a", "b")).alias("doc")).select(slot("doc").cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    wanted = np.zeros(SLOTS, bool)
    wanted[used] = True
    wanted = pairs.sparkSession.sparkContext.broadcast(wanted)
    sets = scratch.keep(f"{name}_sets", own.select("key", "text", slot("key").alias("slot")).mapInArrow(frugal(_sets(wanted)), f"doc {kind}, tokens array<long>"))
    b = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")).join(bounded(pairs, LABEL_ROWS), "b")
    a = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")).join(bounded(pairs.select("a").distinct(), LABEL_ROWS), "a", "left_semi")
    out = scratch.keep(name, b.join(a, "a").where(_similar(F.size(F.array_intersect("ta", "tb")), F.col("ta"), F.col("tb"), percent)).select("a", "b").distinct())
    scratch.drop(f"{name}_sets")
    wanted.destroy()
    return out


def _open_groups(percent: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a query and a member of a block of a group: only blocks whose token union can hold enough of the query are opened."""
        found = []
        own = [(d, n, np.frombuffer(x, np.uint8)) for d, n, x in zip(members["doc"], members["n"], members["bits"], strict=True)]
        size = max((len(x) for _, _, x in own), default=1)
        union = np.bitwise_or.reduce([resized(x, size) for _, _, x in own], axis=0) if own else np.zeros(1, np.uint8)
        for q, n, x in zip(queries["doc"], queries["n"], queries["bits"], strict=True):
            bits = np.frombuffer(x, np.uint8)
            if within(bits, n, union) >= _required(n, percent):
                found += [(q, d) for d, m, y in own if d != q and _fit(n, bits, m, y, percent)]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def link_similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` for each row of ``docs``: the least key that links reach from it.

    Words are what stands between SPACES, A-Z in lower case; a document's set holds its distinct five-word shingles, or all
    words as one if there are fewer. Two documents link when their sets' Jaccard similarity is ``percent`` hundredths or
    more; no link is lost and none is estimated.

    1. Documents with equal sets are one class, represented by the least key.
    2. Shingles are ordered by hash, frequent ones last (those that come twice in a task, the FREQUENT most reported; any
       order is right, this one keeps what many documents share out of prefixes). Similar sets share a shingle in their
       prefixes of n - ceil(n * percent / 100) + 1.
    3. Similar documents are partitioned into groups: the hub of a shingle is the document that holds it in its prefix and has
       the largest share of frequent shingles (an original rather than its altered copies). Each document meets the hub that
       it shares most shingles with; pairs that pass the exact test are joined to components.
    4. The token-group matrix holds the shingles of each group's members, in blocks of about MEMBERS, with the range of their
       sizes. A document of another, smaller group is a query where it shares a shingle with a block and sizes allow it.
       Each block stores its token union as a bitmap (see ``bitmap``). What of the query lies outside of it is known at
       least, so its overlap is bounded: only a block that can reach the threshold is opened, and members whose own bitmaps
       leave it possible are compared by their sets. These links and those of step 3 give the components.

    Steps 3 and 4 together try every pair in different groups that shares a prefix shingle, so groups need no pairs within.
    Texts are read four times and never shuffled. Sets are kept for documents of pairs that bitmaps leave possible only; a
    filter of SLOTS bits tells them. A hot shingle's documents are salted for step 3, blocks and their queries are salted,
    classes hold one row, and tokens and labels join where the engine splits hot keys. Sets are hashes: shingles are told
    apart by 64 bits, equal sets by 128.

    Null and empty texts have an empty set, link with nothing and are their own component. A row with a null key is in no
    group of its own: its component is that of the keyed rows with an equal set, or null. Rows that share a key are one
    document with the links of all. A very long text is hashed in parts and has one set. An empty table gives an empty
    result. Only ``key`` and ``text`` are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    survey = scratch.keep("survey", own.mapInArrow(frugal(_survey), f"key {kind}, n long, k1 long, k2 long, bits binary, token long, count long"))
    keyed = own.where("key IS NOT NULL")

    frequent = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    tokens = frequent.column("token").to_numpy().view(np.uint64)
    by_token = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[by_token], frequent.column("c").to_numpy()[by_token]))

    prefixes = keyed.mapInArrow(frugal(_prefixes(frequent, percent)), f"key {kind}, n long, k1 long, k2 long, common long, prefix array<long>, salts array<int>")
    classes = prefixes.where("n > 0").groupBy("k1", "k2", "n", "common").agg(F.min("key").alias("doc"), F.any_value(F.arrays_zip("prefix", "salts")).alias("prefix"))
    rows = classes.select("doc", F.col("n").cast("int").alias("n"), F.col("common").cast("int").alias("common"), F.posexplode("prefix").alias("pos", "p"))
    rows = rows.select("doc", "n", "common", "pos", F.col("p.prefix").alias("token"), F.col("p.salts").alias("salt"))
    line = Window.partitionBy("token", "salt").orderBy("n", "doc")
    rows = rows.withColumns({"prev_n": F.lag("n").over(line), "next_n": F.lead("n").over(line)})
    rows = rows.where((F.col("salt") > 0) | (100 * F.col("prev_n") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("next_n"))).drop("prev_n", "next_n")
    star = Window.partitionBy("token", "salt").orderBy(F.desc("common"), "n", "doc")
    rows = rows.withColumns({f"hub{c}": F.first(c).over(star) for c in ("doc", "n", "pos")})
    shared = scratch.keep("shared", rows.drop("common", "salt"))
    frequent.destroy()

    # One row for each document with a candidate: what stands for its set until pairs are verified.
    some = shared.select("doc").distinct()
    bits = survey.where("token IS NULL").select(F.col("key").alias("doc"), F.col("n").cast("int").alias("n"), "bits").join(bounded(scratch.keep("some", some), LABEL_ROWS), "doc", "left_semi")
    bits = scratch.keep("bits", bits.distinct())

    def fits(n: Column, pos: Column, other_n: Column, other_rest: Column) -> Column:
        """Whether sets of these sizes can still be similar if this is the first shingle that they share."""
        need = F.ceil(percent * (n + other_n) / (100 + percent))
        return (n - pos >= need) & (other_rest >= need)

    close = (100 * F.least("n", "hubn") >= percent * F.greatest("n", "hubn")) & fits(F.col("n"), F.col("pos"), F.col("hubn"), F.col("hubn") - F.col("hubpos"))
    near = shared.where((F.col("doc") != F.col("hubdoc")) & close).groupBy("doc", "hubdoc").agg(F.count(F.lit(1)).alias("c"))
    best = near.groupBy("doc").agg(F.max(F.struct("c", "hubdoc")).alias("m")).select(F.col("m.hubdoc").alias("a"), F.col("doc").alias("b"))
    side = lambda c: bits.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
    best = best.join(side("b"), "b").join(side("a"), "a").mapInArrow(_may_link(percent), f"a {kind}, b {kind}")
    links = _verified(scratch, "links", scratch.keep("best", best), keyed, kind, percent)
    groups = scratch.keep("groups", components(scratch, links, "g"))

    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labels = scratch.keep("labels", groups.join(size, "component"))
    block = F.when(F.col("size") > MEMBERS, F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / MEMBERS))).otherwise(0).cast("long")
    grouped = shared.join(bounded(labels.withColumnRenamed("node", "doc"), LABEL_ROWS), "doc", "left")
    grouped = grouped.select("token", "doc", "n", "pos", F.coalesce("component", "doc").alias("g"), F.coalesce("size", F.lit(1)).alias("size")).withColumn("block", block)
    # Shingles of one group only lead to no other.
    several = grouped.groupBy("token").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least <> most").select("token")
    grouped = scratch.keep("grouped", grouped.join(several, "token", "left_semi"))

    matrix = grouped.groupBy("token", "g", "size", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    matrix = matrix.select("token", F.col("g").alias("h"), F.col("size").alias("h_size"), "block", "lo", "hi", "rest")
    asked = grouped.select("token", "doc", "n", "pos", "g", "size").join(matrix, "token").where("size < h_size OR (size = h_size AND g < h)")
    asked = asked.where((100 * F.col("hi") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("lo")))
    smallest = F.greatest("lo", F.ceil(F.col("n") * percent / 100))
    asked = asked.where(fits(F.col("n"), F.col("pos"), smallest, F.col("rest"))).select("doc", "h", "block").distinct()
    asked = scratch.keep("asked", asked)
    salts = asked.groupBy("h", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("salts"))
    queries = asked.join(salts, ["h", "block"]).withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts"))).select("doc", "h", "block", "salt")
    members = grouped.select("doc", F.col("g").alias("h"), "block").distinct().join(salts, ["h", "block"])
    members = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("doc", "h", "block", "salt")
    # Few bytes, much work: as many tasks as a shuffle has.
    by, tasks = ["h", "block", "salt"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    members, queries = (x.join(bits.select(*[F.col(c).alias(c) for c in bits.columns]), "doc").repartition(tasks, *by) for x in (members, queries))
    opened = members.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(_open_groups(percent), f"a {kind}, b {kind}")
    more = _verified(scratch, "more", scratch.keep("opened", opened.distinct()), keyed, kind, percent)
    links = scratch.keep("all_links", links.unionByName(more))
    for name in ("shared", "bits", "grouped", "asked", "labels", "groups"):
        scratch.drop(name)

    found = components(scratch, links, "c")
    classes = survey.where("token IS NULL").groupBy("k1", "k2", "n").agg(F.min("key").alias("doc"))
    classes = classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("k1", "k2", "n", F.coalesce("component", "doc").alias("component_id"))
    classes = scratch.keep("classes", classes.where("n > 0"))
    rows = survey.where("token IS NULL").select("key", F.col("n").alias("n_shingles"), "k1", "k2")
    out = rows.join(classes, (rows["k1"] == classes["k1"]) & (rows["k2"] == classes["k2"]) & (rows["n_shingles"] == classes["n"]), "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose key is the least of its component, with all their columns; rows with null keys stay."""
    found = link_similar(docs, key=key, text=text, percent=percent)
    gone = Scratch(docs.sparkSession, "copies").keep("gone", found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__tm_key"), F.xxhash64(key).alias("__tm_h")).distinct())
    return anti_listed(docs, F.xxhash64(key), gone, "__tm_h", lambda d, g: d[key] == g["__tm_key"])
