"""Lines that a speaker gives up and takes again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx

#: Tokens of a head at most: as many distinct ones of two heads have a letter each.
LONGEST_HEAD = 64


def shared_prefix(a: Column, b: Column) -> Column:
    """How many tokens two arrays have in common from their beginning."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct(
        F.when(s["on"] & F.coalesce(same, F.lit(False)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & F.coalesce(same, F.lit(False))).alias("on")), lambda s: s["n"])


def token_distance(a: Column, b: Column, most: int) -> Column:
    """The edit distance of two arrays of at most LONGEST_HEAD tokens, null beyond ``most``: each token is a letter, and only the band around the diagonal is worked out."""
    every = F.concat(a, b)
    letters = lambda x: F.array_join(F.transform(x, lambda t: F.char(F.array_position(every, t) + 64)), "")
    found = F.levenshtein(letters(a), letters(b), most)
    return F.when(found >= 0, found)


def retaken(lines: DataFrame, keys: list[str], order: str, text: str, fillers: list[str], *, within: int = 3, head: int = 6, least: int = 2, edits: int = 1) -> DataFrame:
    """Lines that one of the next ``within`` lines of the same keys begins like: starts given up and taken again.

    Tokens are runs of letters and digits in lower case, fillers left out. The line's head, ``head`` tokens at most, is aligned with
    the beginning of the later line, however many tokens of it fit best: the line was given up if it has ``least`` tokens and
    both are at most ``edits`` insertions, deletions and changes of a token apart, fewer than ``least``. Returns the rows with ``again`` (``order`` of the first line that
    does), ``shared`` (tokens in common from the beginning) and ``distance``. Null texts have no tokens. One window over the
    keys; a line meets only the few lines behind it.
    """
    most = min(edits, least - 1)
    if not 0 < head <= LONGEST_HEAD - most:
        raise ValueError(f"heads have 1 to {LONGEST_HEAD - most} tokens")
    said = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), tx.BETWEEN)
    for f in ["", *fillers]:
        said = F.array_remove(said, f)  # compiled, where a filter isn't
    own = lines.withColumn("__long", F.slice(said, 1, head + most)).withColumn("__head", F.slice("__long", 1, head))
    window = Window.partitionBy(*keys).orderBy(order)
    for d in range(1, within + 1):
        own = own.withColumn(f"__at{d}", F.lead(order, d).over(window)).withColumn(f"__to{d}", F.lead("__long", d).over(window))

    def may(b: Column) -> Column:
        """Of the first tokens one more than edits has its equal, shifted by as many places at most; lines without it are told apart at once."""
        return F.arrays_overlap(F.slice("__head", 1, most + 1), F.slice(b, 1, 2 * most + 1))

    def aligned(b: Column) -> Column:
        tries = [token_distance(F.col("__head"), F.slice(b, 1, F.size("__head") + e), most) for e in range(-most, most + 1)]
        return F.array_min(F.array(*tries))

    tried = F.array(*[
        F.when((F.size("__head") >= least) & may(F.col(f"__to{d}")), F.struct(F.col(f"__at{d}").alias("again"), shared_prefix(F.col("__head"), F.col(f"__to{d}")).alias("shared"), aligned(F.col(f"__to{d}")).alias("distance")))
        for d in range(1, within + 1)
    ])
    found = own.withColumn("__first", F.get(F.filter(tried, lambda s: s["distance"].isNotNull()), 0)).where("__first IS NOT NULL")
    return found.select(*lines.columns, "__first.again", "__first.shared", "__first.distance")
