"""Queries over lines, caps, trees and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import caps, lines, sketches, trees
from tidemark.plans.registry import query
from tidemark.plans.timeline import E_SQL, FILLERS, _seconds
from tidemark.sources.shared import fresh_folder
from tidemark.sources.tables import table

FILLER_SQL = ", ".join(f"'{f}'" for f in FILLERS)


def _lead_sql(d: int) -> str:
    letters = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(CAST(list_position(list_concat(head, b), t) + 64 AS INT))), '')"
    tries = ", ".join(f"levenshtein({letters('head')}, {letters(f'b[1:len(head) + {e}]')})" for e in (-1, 0, 1))
    return f"""SELECT doc_id, line, {d} AS d, at{d} AS again, least({tries}) AS distance,
               coalesce(list_min(list_filter(range(0, CAST(len(head) AS BIGINT)), lambda i: head[i + 1] IS DISTINCT FROM b[i + 1])), len(head)) AS shared
               FROM (SELECT *, to{d} AS b FROM w WHERE len(head) >= 2 AND at{d} IS NOT NULL)"""


@query(
    "retaken_lines",
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
         k AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND t NOT IN ({FILLER_SQL})) AS tokens FROM l),
         h AS (SELECT doc_id, line, tokens[1:6] AS head, tokens[1:7] AS long FROM k),
         w AS (SELECT *, {", ".join(f"lead(line, {d}) OVER o AS at{d}, lead(long, {d}) OVER o AS to{d}" for d in (1, 2, 3))} FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
         t AS ({" UNION ALL ".join(map(_lead_sql, (1, 2, 3)))})
    SELECT doc_id, line, again, CAST(shared AS INT) AS shared, CAST(distance AS INT) AS distance FROM t WHERE distance <= 1 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY d) = 1
    """,
)
def retaken_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of a document as what one speaker says, some of it given up and said again."""
    own = table(spark, root, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = lines.retaken(own.withColumn("line", F.col("line").cast("long")), ["doc_id"], "line", "text", FILLERS)
    return found.select("doc_id", "line", "again", "shared", "distance")


#: Units of ten minutes that a user's chosen events may take.
CAP = 60


@query(
    "value_cap",
    f"""
    WITH RECURSIVE {E_SQL},
         i AS (SELECT user_id, event_id, t AS t0, t + (1 + event_id % 12) * 600 AS t1, CAST(floor(value * 100) AS BIGINT) AS v, 1 + event_id % 12 AS c FROM e),
         l AS (SELECT user_id, list(t0 ORDER BY t1, event_id) AS t0s, list(t1 ORDER BY t1, event_id) AS t1s, list(v ORDER BY t1, event_id) AS vs, list(c ORDER BY t1, event_id) AS cs, count(*) AS n FROM i GROUP BY user_id),
         p AS (SELECT *, list_transform(t0s, lambda t: len(list_filter(t1s, lambda u: u <= t))) AS free FROM l),
         f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, [list_transform(range(0, {CAP + 1}), lambda c: CAST(0 AS BIGINT))] AS best FROM p
               UNION ALL SELECT f.user_id, k + 1, list_append(best, list_transform(range(0, {CAP + 1}), lambda c: greatest(best[k + 1][c + 1], CASE WHEN c >= cs[k + 1] THEN vs[k + 1] + best[free[k + 1] + 1][c - cs[k + 1] + 1] ELSE 0 END)))
               FROM f JOIN p USING (user_id) WHERE k < n)
    SELECT user_id, best[n + 1][{CAP + 1}] AS value, TRUE AS fits FROM f JOIN p USING (user_id) WHERE k = n
    """,
)
def value_cap(spark: SparkSession, root: str) -> DataFrame:
    """What a user's events are worth at most, none at the time of another, in ten hours."""
    long = (1 + F.col("event_id") % 12).cast("long")
    items = _seconds(spark, root).select("user_id", "event_id", F.col("t").alias("t0"), (F.col("t") + long * 600).alias("t1"), F.floor(F.col("value") * 100).cast("long").alias("v"), long.alias("c"))
    kept = caps.capped_by_value(items, ["user_id"], "event_id", "v", "c", CAP, "t0", "t1")
    return kept.groupBy("user_id").agg(F.sum("v").alias("value"), (F.sum("c") <= CAP).alias("fits"))


@query(
    "whole_listing",
    r"""
    WITH RECURSIVE u AS (SELECT page_id, list_concat(list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')), list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS steps FROM pages),
         n AS (SELECT DISTINCT array_to_string(steps[1:k], '/') AS node, array_to_string(steps[1:k - 1], '/') AS parent, steps[k] AS name FROM (SELECT steps, unnest(range(1, len(steps) + 1)) AS k FROM u)),
         r AS (SELECT node, 1 AS depth, [name] AS path FROM n WHERE parent = 'com' UNION ALL SELECT n.node, r.depth + 1, list_append(r.path, n.name) FROM r JOIN n ON n.parent = r.node)
    SELECT node, CAST(depth AS INT) AS depth, array_to_string(path, '/') AS path FROM r
    """,
)
def whole_listing(spark: SparkSession, root: str) -> DataFrame:
    """All that lies below one top domain: hosts from their last label on, then the folders of their pages."""
    host = F.reverse(F.split(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"\."))
    folders = F.filter(F.split(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    steps = table(spark, root, "pages").select(F.concat(host, folders).alias("steps"))
    each = steps.select("steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("k"))
    upto = lambda k: F.array_join(F.slice("steps", 1, k), "/")
    nodes = each.select(upto(F.col("k")).alias("node"), upto(F.col("k") - 1).alias("parent"), F.get("steps", F.col("k") - 1).alias("name")).distinct()
    found = trees.descendants(nodes, "node", "parent", "name", spark.sql("SELECT 'com' AS node"))
    return found.select("node", "depth", F.array_join("path", "/").alias("path"))


@query("distinct_in_weeks", "SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS BIGINT) AS week, count(DISTINCT user_id) AS n_users, TRUE AS within FROM events GROUP BY 1")
def distinct_in_weeks(spark: SparkSession, root: str) -> DataFrame:
    """Users of each week from the sketches of its days, which are kept, beside the exact count."""
    days = table(spark, root, "events").select("user_id", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    path = fresh_folder(spark, "sketches")
    sketches.sketched(days, ["day"], F.col("user_id")).write.parquet(path)
    week = F.floor(F.col("day") / 7).cast("long").alias("week")
    kept = spark.read.schema("day int, sketch binary").parquet(path).select(week, "sketch")
    exact = days.groupBy(week).agg(F.count_distinct("user_id").alias("n_users"))
    return sketches.merged(kept, ["week"]).join(exact, "week").select("week", "n_users", sketches.within_bound(F.col("estimate"), F.col("n_users")).alias("within"))
