"""Trees of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_folder


def descendants(items: DataFrame, item: str, parent: str, name: str, roots: DataFrame) -> DataFrame:
    """Everything below ``roots`` (a column ``item``), at any depth: ``item``, ``root``, ``depth`` (from 1) and ``path``, the names on the way.

    One join a level: the items that the last round found meet those whose parent they are; each round is added to one table in the
    shared folder, so neither plans nor lineage grow with depth. Rounds end when one finds nothing. An item is found once for each root, on its
    shortest way, of equal ones by the least path; what was found before isn't entered again, so cycles end. Null parents are below nothing.
    """
    spark = items.sparkSession
    path = fresh_folder(spark, "tree")
    children = items.select(F.col(item).alias("__item"), F.col(parent).alias("__parent"), F.col(name).alias("__name"))
    new = roots.select(F.col(item), F.col(item).alias("root"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path")).distinct()
    depth = 0
    while True:
        new.write.mode("append").parquet(path)
        found = spark.read.schema(new.schema).parquet(path)
        level = found.where(F.col("depth") == depth)
        if level.isEmpty():
            return found.where("depth > 0")
        depth += 1
        below = level.join(children, level[item] == children["__parent"]).select(F.col("__item").alias(item), "root", F.lit(depth).alias("depth"), F.concat("path", F.array("__name")).alias("path"))
        new = below.groupBy(item, "root", "depth").agg(F.min("path").alias("path")).join(found.select(item, "root"), [item, "root"], "left_anti")
