"""Connected components of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, label: str) -> DataFrame:
    """(``node``, ``component``) for each end of ``links`` (``a``, ``b``); the component is its least node.

    Each round links every node's larger neighbours to the least node it sees, then its smaller ones; the number of rounds
    grows with the square of the logarithm of the longest path at most. Neighbours are never gathered: least nodes are
    map-side aggregates, joined back where the engine can split a hot node. Rounds are written to the shared folder.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.keep(f"{label}0", links.where("a <> b").select(hi, lo).distinct())
    seen, k = None, 0
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen, k = mark, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(f"{label}{k}large", large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = scratch.keep(f"{label}{k}", small.where("u <> v").distinct())
        scratch.drop(f"{label}{k}large")
        scratch.drop(f"{label}{k - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
