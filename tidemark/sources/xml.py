"""Timelines exchanged as XML documents, one row element for each clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_rows(spark: SparkSession, path: str, tag: str, schema: StructType) -> DataFrame:
    """The ``tag`` elements of the files at ``path`` as rows. A row that doesn't fit the schema stops the read."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)


def write_rows(rows: DataFrame, path: str, root: str, tag: str) -> None:
    """``rows`` as elements ``tag`` below ``root``, a file for each task."""
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).mode("errorifexists").save(path)
