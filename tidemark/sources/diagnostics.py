"""Diagnostics as JSON: a component and its status, where not checked isn't failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "component string, status string, message string"


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA with ``healthy``: true, false, or null for what was not checked."""
    healthy = F.when(F.col("status") == "ok", True).when(F.col("status") == "not_checked", F.lit(None).cast("boolean")).otherwise(False)
    return spark.read.schema(SCHEMA).json(path).withColumn("healthy", healthy)


def write_checked(rows: DataFrame, failures: DataFrame, path: str) -> None:
    """Writes ``rows`` as Parquet unless a check has found failures; then nothing is written."""
    if (bad := failures.take(3)) != []:
        raise ValueError(f"refused: a check failed, for example on {bad}")
    rows.write.mode("errorifexists").parquet(path)
