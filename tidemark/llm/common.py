"""What the operators of this subpackage share: scratch tables, bindings inside expressions, folding of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_folder

#: Bytes that part words: space, and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"

#: Bits of the filter in ``split_listed``, whatever the input: 16 MB.
FILTER_BITS = 1 << 27


class Scratch:
    """Tables written below the shared folder: they cut lineage, and survive the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, fresh_folder(spark, label)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing still to be computed reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Maximal runs of other characters than SPACES; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def by_bytes(items: Iterable, size: Callable, limit: int) -> Iterator[list]:
    """Lists of consecutive items of about ``limit`` bytes each; a larger item is alone."""
    held: list = []
    total = 0
    for x in items:
        n = size(x)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(x)
        total += n
    if held:
        yield held


def shingle_hashes(ws: Column, k: int = 5) -> Column:
    """A 64-bit hash of each run of ``k`` words; of all words for a shorter sequence; none without words."""

    def of(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        runs = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(runs)

    return let(ws, of)


def shingles(ws: Column, k: int = 5) -> Column:
    """The distinct runs of ``k`` words as text, as in ``shingle_hashes``."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return let(ws, of)


def row_hash(key: str, text: str) -> Column:
    """With ``key``, what tells rows apart where keys are null or repeated; rows with equal keys and texts are alike."""
    return F.xxhash64(F.col(key), F.col(text))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with the hint to broadcast it if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_listed(rows: DataFrame, h: Column, listed: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose 64-bit hash ``h`` may be one of ``listed``'s column ``c``, and those whose hash surely isn't.

    A bitmap of FILTER_BITS bits is broadcast, in rows of 4 KB, so its size doesn't depend on the input. Only the first part
    needs to be shuffled to meet the list; where the list has far more rows than bits, that is nearly all.
    """
    bit = lambda x: F.pmod(x, F.lit(FILTER_BITS)) + 1
    bits = listed.select(F.bitmap_bucket_number(bit(F.col(c))).alias("__tm_bucket"), F.bitmap_bit_position(bit(F.col(c))).alias("__tm_bit"))
    bits = F.broadcast(bits.groupBy("__tm_bucket").agg(F.bitmap_construct_agg("__tm_bit").alias("__tm_bits")))
    met = rows.withColumn("__tm_at", bit(h)).withColumn("__tm_bucket", F.bitmap_bucket_number("__tm_at")).join(bits, "__tm_bucket", "left")
    at = F.bitmap_bit_position("__tm_at")
    byte = F.conv(F.hex(F.substring("__tm_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = met.withColumn("__tm_listed", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).select(*rows.columns, "__tm_listed")
    return met.where("__tm_listed").drop("__tm_listed"), met.where("NOT __tm_listed").drop("__tm_listed")


def anti_listed(rows: DataFrame, h: Column, listed: DataFrame, c: str, same: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """The ``rows`` that ``same`` joins to none of ``listed``; only those that may be listed are shuffled."""
    may, rest = split_listed(rows, h, listed, c)
    return may.join(listed, same(may, listed), "left_anti").unionByName(rest)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs that are started meanwhile hand rows to Arrow functions in batches of about ``size`` bytes, however long the texts are.

    Both the engine's side and the worker's hold a batch whole, so batches by rows alone grow with the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for Arrow batches; at a task's end the worker, which stays for the next one, gives unused memory back."""

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole
