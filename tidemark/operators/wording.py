"""What to put on the screen, what to take out, what to screen: by corpus statistics, context and checks of what patterns hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources.shared import fresh_folder


#: Words are runs of letters and digits, as in ``functions.text.tokens``; what parts them.
PARTS = r"[^\p{L}\p{N}]+"
#: Bytes of text and rows that are counted at once inside a task; so numbers of a row and two words fit one of 63 bits.
PART_BYTES, PART_ROWS = 1 << 24, 1 << 13


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into parts of at most PART_BYTES of text, one row at least, and PART_ROWS rows."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            z = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PART_BYTES, side="right"))
            z = min(max(z, a + 1), a + PART_ROWS)
            yield batch.slice(a, z - a)
            a = z


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of lower-case ``texts``, and for each place of a word its number, its text and its line."""
    lines = pc.split_pattern(texts, "\n")
    words = pc.split_pattern_regex(lines.flatten(), PARTS)
    found, line = words.flatten(), pc.list_parent_indices(words)
    is_word = pc.not_equal(found, "")
    found, line = found.filter(is_word).dictionary_encode(), line.filter(is_word).to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), row[line], line


def _counted(docs: DataFrame, key: str, text: str, phrases: bool, merged: bool) -> DataFrame:
    """(``key``, ``term``, ``n``) for each distinct term of each row, or ``merged`` (``term``, ``n``, ``n_docs``) for each of some rows of a task: words, and with ``phrases`` pairs of neighbouring words of a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            names, word, row, line = _words(part.column("__text"))
            size, rows = len(names), part.num_rows
            if not len(word):
                continue
            if phrases:
                beside = line[1:] == line[:-1]
                word, row = np.concatenate([word, size + word[:-1][beside] * size + word[1:][beside]]), np.concatenate([row, row[:-1][beside]])
            each, n = np.unique(word * rows + row, return_counts=True)
            term, row = np.divmod(each, rows)
            if merged:
                at = np.flatnonzero(np.diff(term, prepend=-1))
                n, n_docs, term = np.add.reduceat(n, at), np.diff(at, append=len(term)), term[at]
            singles = int(np.searchsorted(term, size))
            pair = term[singles:] - size
            terms = pa.concat_arrays([names.take(pa.array(term[:singles])), pc.binary_join_element_wise(names.take(pa.array(pair // size)), names.take(pa.array(pair % size)), " ")])
            if merged:
                yield pa.RecordBatch.from_arrays([terms, pa.array(n), pa.array(n_docs)], ["term", "n", "n_docs"])
            else:
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), terms, pa.array(n)], [key, "term", "n"])

    kind = "" if merged else f"`{key}` {docs.schema[key].dataType.simpleString()}, "
    return docs.select(key, F.lower(text).alias("__text")).mapInArrow(run, f"{kind}term string, n long" + (", n_docs long" if merged else ""))


def _counts(terms: Column) -> Column:
    """(``term``, ``n``) for each distinct element of an array, by the runs of equal ones when sorted."""
    given = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return given(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"))))

    return given(F.sort_array(terms), runs)


def _by_key(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key is their own, and those that share theirs, if there are any."""
    again = docs.groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again")
    if again.isEmpty():
        return docs, None
    same = docs[key].eqNullSafe(again["__again"])
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def _terms_of(docs: DataFrame, key: str, text: str, phrases: bool = True) -> DataFrame:
    """(``key``, ``term``, ``n``) for each distinct term of each document. A row whose key is its own is counted where it is read; only rows that share theirs are shuffled."""
    alone, several = _by_key(docs, key)
    own = _counted(alone, key, text, phrases, False)
    return own if several is None else own.unionByName(_counted(several, key, text, phrases, False).groupBy(key, "term").agg(F.sum("n").alias("n")))


def _term_counts(docs: DataFrame, key: str, text: str, phrases: bool) -> DataFrame:
    """(``term``, ``n``, ``n_docs``) of all documents: rows are merged inside of tasks first."""
    alone, several = _by_key(docs, key)
    own = _counted(alone, key, text, phrases, True)
    if several is not None:
        shared = _counted(several, key, text, phrases, False).groupBy(key, "term").agg(F.sum("n").alias("n"))
        own = own.unionByName(shared.select("term", "n", F.lit(1).cast("long").alias("n_docs")))
    return own.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def term_statistics(docs: DataFrame, key: str, text: str, *, phrases: bool = True, least: int = 2, lift: float = 10.0) -> DataFrame:
    """(``term``, ``n``, ``n_docs``, ``lift``): how often each word and, with ``phrases``, each phrase occurs, and in how many documents.

    A phrase is a pair of neighbouring words of a line that occurs ``least`` times, and at least ``lift`` times as often as its
    words would meet by chance; ``lift`` is null for single words. A row tells the counts of its distinct terms by itself and
    tasks merge counts, so a hot word is a row for each task and one shuffle of merged counts is all; pairs that are too seldom
    end there. Counts are a table in the shared folder, and only the number of all words reaches the driver. Null texts have no words;
    equal keys count as one document.
    """
    spark = docs.sparkSession
    counted = _term_counts(docs, key, text, phrases)
    is_pair = F.contains("term", F.lit(" "))
    path = fresh_folder(spark, "terms")
    counted.where(~is_pair | (F.col("n") >= least)).write.parquet(path)
    counted = spark.read.schema("term string, n long, n_docs long").parquet(path)
    single = counted.where(~is_pair).withColumn("lift", F.lit(None).cast("double"))
    if not phrases:
        return single
    pairs = counted.where(is_pair).withColumns({"__a": F.substring_index("term", " ", 1), "__b": F.substring_index("term", " ", -1)})
    total = float(single.agg(F.sum("n")).first()[0] or 0)
    for side in ("__a", "__b"):
        pairs = pairs.join(single.select(F.col("term").alias(side), F.col("n").cast("double").alias(f"{side}_n")), side)
    pairs = pairs.withColumn("lift", F.col("n") * F.lit(total) / (F.col("__a_n") * F.col("__b_n"))).where(F.col("lift") >= lift)
    return single.unionByName(pairs.select("term", "n", "n_docs", "lift"))


def punch_words(docs: DataFrame, statistics: DataFrame, key: str, text: str, n_docs: int, *, k: int = 3, common: float = 0.2) -> DataFrame:
    """The ``k`` words and phrases of each document that mark it most: (``key``, ``rank``, ``term``, ``n``, ``score``).

    ``score`` is a thousand times the count in the document by the logarithm of how rare the term is among ``n_docs``
    documents, rounded; ties go to the longer term, then by the alphabet. What is in more than the share ``common`` of the documents or
    is a single letter marks none; leaving that out first also takes the hot terms out of the join. Documents without such
    terms, with null or empty texts have no row. Equal keys count as one document.
    """
    own = _terms_of(docs, key, text).where(F.length("term") > 1)
    rare = statistics.where(F.col("n_docs") <= common * n_docs).select("term", F.col("n_docs").alias("__df"))
    scored = own.join(rare, "term").withColumn("score", F.round(1000 * F.col("n") * F.log(F.lit(float(n_docs)) / F.col("__df"))).cast("long"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(F.length("term")), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(key, "rank", "term", "n", "score")


def definition_cards(docs: DataFrame, statistics: DataFrame, key: str, text: str, n_docs: int, pattern: str, *, common: float = 0.2) -> DataFrame:
    """Sentences that define a term: (``key``, ``sentence``, ``term``, ``definition``), ``sentence`` counted from 0.

    ``pattern`` matches a whole sentence with two groups, the term and what it is said to be. A term all of whose words are
    in more than the share ``common`` of the documents ("it", "this") is none. Sentences end at a full stop, a question or exclamation
    mark with space behind it, or at the end of a line. Null texts have no sentences.
    """
    sentences = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?][ \t]+|\n")).alias("sentence", "__s"))
    hit = sentences.where(F.col("__s").rlike(pattern)).select(key, F.col("sentence").cast("long"), *[F.regexp_extract("__s", pattern, g).alias(c) for g, c in ((1, "term"), (2, "definition"))])
    words = hit.select("term").distinct().select("term", F.explode(F.array_distinct(tx.tokens(F.col("term")))).alias("__w"))
    rare = statistics.where(F.col("n_docs") <= common * n_docs).select(F.col("term").alias("__w"))
    named = words.join(rare, "__w", "left_semi").select("term").distinct()
    return hit.join(named, "term", "left_semi").select(key, "sentence", "term", "definition")


def fillers_by_context(words: DataFrame, keys: list[str], order: list[str], word: str, start: str, end: str, sure: list[str], doubtful: list[str], pause: int) -> DataFrame:
    """Words that carry nothing where they stand, with the ``reason``.

    ``sure`` words are fillers anywhere. ``doubtful`` ones ("well", "like") are if at least ``pause`` ticks lie on both sides, or
    nothing at all. A word that is said again right away, alone or with the word behind it as a pair, within ``pause``, is
    a repeat, of which only the last stays. The first reason of ``sure``, ``repeat``, ``pause`` is given. Words are compared in lower
    case; null words are none. One window over the keys.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    low = words.withColumn("__w", F.lower(word))
    at = {d: (F.lead if d > 0 else F.lag)("__w", abs(d)).over(window) for d in (1, 2, 3, -1)}
    own = low.withColumns({
        "__n1": at[1], "__n2": at[2], "__n3": at[3], "__b1": at[-1], "__before": F.col(start) - F.lag(end).over(window), "__after": F.lead(start).over(window) - F.col(end),
    })
    own = own.withColumn("__next_after", F.lead("__after").over(window))
    soon = lambda c: F.coalesce(F.col(c) < pause, F.lit(False))
    again = F.coalesce((F.col("__w") == F.col("__n1")), F.lit(False)) & soon("__after")
    pair = F.coalesce((F.col("__w") == F.col("__n2")) & (F.col("__n1") == F.col("__n3")) & (F.col("__w") != F.col("__n1")), F.lit(False)) & soon("__after") & soon("__next_after")
    own = own.withColumn("__pair", pair)
    second = F.coalesce(F.lag("__pair").over(window), F.lit(False))
    alone = (F.coalesce(F.col("__before") >= pause, F.lit(True))) & F.coalesce(F.col("__after") >= pause, F.lit(True))
    reason = F.when(F.col("__w").isin(*sure), "sure").when(again | F.col("__pair") | second, "repeat").when(F.col("__w").isin(*doubtful) & alone, "pause")
    return own.withColumn("reason", reason).where("reason IS NOT NULL").select(*words.columns, "reason")


def luhn_valid(digits: Column) -> Column:
    """Whether the last digit of a string of digits is its Luhn check digit."""
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    each = F.transform(F.reverse(F.split(digits, "(?!^)(?!$)")), worth)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def octets_valid(address: Column) -> Column:
    """Whether four numbers with dots between are an address that isn't of the own machine, a private net or nobody's."""
    part = lambda i: F.split_part(address, F.lit("."), F.lit(i)).cast("int")
    own = part(1).isin(0, 10, 127) | ((part(1) == 192) & (part(2) == 168)) | ((part(1) == 172) & part(2).between(16, 31))
    return (F.greatest(*[part(i) for i in (1, 2, 3, 4)]) <= 255) & ~own


def varied(value: Column, least: int) -> Column:
    """Whether a string has at least ``least`` different characters, digits and letters among them."""
    return (F.size(F.array_distinct(F.split(value, "(?!^)(?!$)"))) >= least) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def hits(rows: DataFrame, text: str, rules: dict) -> DataFrame:
    """``rows`` with ``n_<name>`` for each rule: how many of what its pattern hits (group 1) pass its check too.

    ``rules``: name to (pattern, check), the check a function of a column with the hit. Null texts have no hits.
    """
    found = {name: F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)), check) for name, (pattern, check) in rules.items()}
    return rows.withColumns({f"n_{name}": F.size(x).cast("long") for name, x in found.items()})
