"""A corpus from raw documents to packed sequences; each stage is one operator of ``tidemark.llm`` and works on all that the one before it kept.

Null and empty texts fail the first stage's base rules, so the later ones meet none in a run; given some, they keep them.
Repeated rows share a fate in every stage: of equal texts under different ids one stays, of equal rows under one id all do.
Ties are broken by the least id. An empty table goes through all stages and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Scratch
from tidemark.llm.decontamination import without_items
from tidemark.llm.jaccard_join import keep_first
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import pack_documents
from tidemark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go. Null text fails the base; null languages and sources are groups of their own."""
    return keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go but for the first by id, and documents of which nothing else is left. ``n_chars`` follows a text that changed; null and empty texts stay."""
    return dedup_lines(docs, drop_emptied=True).selectExpr("doc_id", "text", "lang", "source", "CASE WHEN n_lines_removed > 0 THEN CAST(length(text) AS BIGINT) ELSE n_chars END AS n_chars")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the least id. Rows without words or without id stay."""
    return keep_first(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and items hold nothing."""
    return without_items(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids in sequences of 2048; a null or empty text has its end id only."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The last stage needs a tokenizer, which SQL doesn't have; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
