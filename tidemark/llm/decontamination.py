"""Benchmark items found inside documents by containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, anti_listed, bounded, row_hash, shingle_hashes, shingles, split_listed

#: Sketch rows that are broadcast at most.
SKETCH_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _missing(n: Column, percent: int) -> Column:
    """Shingles of n that may be absent when ``percent`` of them or more are there."""
    return n - F.ceil(n * percent / 100).cast("long")


def find_items(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """(``key``, ``item``, n_shingles, n_shared) for each document that holds at least ``percent`` of an item's distinct
    five-word shingles, beside ``__tm_row`` (see ``row_hash``). Words are runs of letters and digits in lower case.

    Items are partitioned by size, doubling. A partition's MinHash sketch is the k least hashes of an item's shingles, with k
    one more than the shingles that the partition's largest size may miss: a document that contains the item must hold one
    of them however long it is, so no document is lost. Items with n shingles that may miss m need k - m of their k hashes.
    Documents are met by a hash join of their shingles with the sketches, which is broadcast while it has at most
    SKETCH_ROWS rows; above that each document's shingles are shuffled. Documents with a candidate, and few others (see
    ``split_listed``), are shuffled to meet it, and what remains is verified with the shingles' text, in both directions of a
    hash collision.

    A document with fewer than five words has one shingle, its words; so has an item. Null or empty texts have none and match
    nothing. Null or repeated keys keep their own rows (equal rows are one); null items are one item. Empty tables give an
    empty result. Only the named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    tests = items.select(F.col(item).alias("__tm_item"), plain_words(F.col(item_text)).alias("w"))
    tests = tests.select("__tm_item", shingles(F.col("w")).alias("__tm_shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("w")))).alias("__tm_hashes"))
    tests = tests.withColumn("__tm_n", F.size("__tm_shingles").cast("long")).where("__tm_n > 0")
    largest = (F.pow(F.lit(2.0), F.floor(F.log2(F.col("__tm_n") + 0.5)) + 1) - 1).cast("long")
    tests = tests.withColumn("__tm_k", F.least(F.col("__tm_n"), _missing(largest, percent) + 1)).withColumn("__tm_least", F.col("__tm_k") - _missing(F.col("__tm_n"), percent))
    tests = scratch.keep("items", tests.withColumn("__tm_no", F.xxhash64("__tm_item", "__tm_shingles")))
    sketch = tests.select("__tm_no", "__tm_least", F.explode(F.slice("__tm_hashes", F.lit(1), F.col("__tm_k").cast("int"))).alias("__tm_h")).distinct()

    # Each task hashes its own documents; only ids leave it.
    hashed = docs.select(F.col(key), row_hash(key, text).alias("__tm_row"), F.explode(shingle_hashes(plain_words(F.col(text)))).alias("__tm_h"))
    hits = hashed.join(bounded(scratch.keep("sketch", sketch), SKETCH_ROWS), "__tm_h").distinct()
    pairs = hits.groupBy(key, "__tm_row", "__tm_no", "__tm_least").agg(F.count(F.lit(1)).alias("__tm_hits")).where("__tm_hits >= __tm_least")
    pairs = scratch.keep("pairs", pairs.select(F.col(key).alias("__tm_key"), F.col("__tm_row").alias("__tm_r"), "__tm_no"))

    own, _ = split_listed(docs.select(key, text, row_hash(key, text).alias("__tm_row")), F.col("__tm_row"), pairs, "__tm_r")
    met = own.join(pairs, own[key].eqNullSafe(pairs["__tm_key"]) & (own["__tm_row"] == pairs["__tm_r"])).select(key, "__tm_row", text, "__tm_no")
    met = met.join(tests.select("__tm_no", F.col("__tm_item").alias(item), "__tm_shingles", F.col("__tm_n").alias("n_shingles")), "__tm_no")
    shared = F.size(F.array_intersect(shingles(plain_words(F.col(text))), "__tm_shingles")).cast("long")
    found = met.select(key, item, "n_shingles", shared.alias("n_shared"), "__tm_row")
    return found.where(100 * F.col("n_shared") >= percent * F.col("n_shingles")).distinct()


def without_items(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = find_items(docs, items, key=key, text=text, **rules).select(F.col(key).alias("__tm_key"), F.col("__tm_row").alias("__tm_r")).distinct()
    found = Scratch(docs.sparkSession, "leaks").keep("found", found)
    return anti_listed(docs, row_hash(key, text), found, "__tm_r", lambda d, f: d[key].eqNullSafe(f["__tm_key"]) & (F.xxhash64(d[key], d[text]) == f["__tm_r"]))
