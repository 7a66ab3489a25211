"""Readers of the tables a query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; a file or a folder, in any store that Spark reads.

    Finding a schema is a job; it is found once for each path of a session, so a table must keep its columns while that lasts."""
    path = f"{root}/{name}.parquet"
    known = _schemas.get((spark.sparkContext.applicationId, path))
    if known is not None:
        return spark.read.schema(known).parquet(path)
    found = spark.read.parquet(path)
    _schemas[spark.sparkContext.applicationId, path] = found.schema
    return found
