"""The ordinary relational operators that timelines need, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query(
    "region_revenue",
    """
    SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY r_name
    """,
)
def region_revenue(spark: SparkSession, root: str) -> DataFrame:
    item = table(spark, root, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01'").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = item.join(table(spark, root, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, root, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("status_totals", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_discount) AS max_discount, count(*) AS n FROM lineitem GROUP BY ALL")
def status_totals(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_shipdate").alias("first_ship"), F.max("l_discount").alias("max_discount"), F.count(F.lit(1)).alias("n")
    )


@query("without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def without_orders(spark: SparkSession, root: str) -> DataFrame:
    large = table(spark, root, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").join(large, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("with_orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def with_orders(spark: SparkSession, root: str) -> DataFrame:
    urgent = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey")


@query("full_outer", "SELECT l.doc_id, l.quality, b.item_id FROM labels l FULL OUTER JOIN benchmark b ON l.doc_id = b.item_id")
def full_outer(spark: SparkSession, root: str) -> DataFrame:
    labels, items = table(spark, root, "labels"), table(spark, root, "benchmark")
    return labels.join(items, labels["doc_id"] == items["item_id"], "full").select("doc_id", "quality", "item_id")


@query("rollup", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events")
    return rows.groupingSets([[F.col("event_type")], [F.col("user_id")], []], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_and_filtered", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY event_type")
def distinct_and_filtered(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("large"))


@query("moments", "SELECT event_type, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS r FROM events GROUP BY event_type")
def moments(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("event_type").agg(
        F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_pop("value"), 6).alias("vp"), F.round(F.corr("value", "user_id"), 6).alias("r")
    )


@query(
    "ranks",
    "SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)",
)
def ranks(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    by_date = w.orderBy("o_orderdate")
    return table(spark, root, "orders").select("o_orderkey", F.rank().over(by_date).cast("long").alias("rank"), F.dense_rank().over(by_date).cast("long").alias("dense"), F.ntile(4).over(w.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("quarter"))


@query("neighbours", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbours(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, root, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"))


@query("day_sums", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS day_sum FROM events")
def day_sums(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").withColumn(
        "day_sum", F.expr("round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4)")
    ).select("event_id", "day_sum")


@query(
    "set_operations",
    """
    SELECT 'both' AS part, n_nationkey AS k FROM (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'rest', k FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
    """,
)
def set_operations(spark: SparkSession, root: str) -> DataFrame:
    nation, customer, supplier = (table(spark, root, t) for t in ("nation", "customer", "supplier"))
    both = nation.select("n_nationkey").intersect(supplier.select("s_nationkey")).toDF("k")
    rest = customer.select("c_custkey").exceptAll(supplier.select("s_suppkey")).toDF("k")
    either = customer.select("c_nationkey").union(supplier.select("s_nationkey")).distinct().toDF("k")
    parts = [x.select(F.lit(name).alias("part"), F.col("k").cast("long").alias("k")) for name, x in (("both", both), ("rest", rest), ("any", either))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("json_field", "SELECT props ->> '$.k' AS k, count(*) AS n FROM events GROUP BY ALL")
def json_field(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("exact_copies", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_copies(spark: SparkSession, root: str) -> DataFrame:
    """Texts that come more than once. A digest is grouped, not the text, so no text is shuffled."""
    rows = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("doc_id", "copies")


@query("scalar_functions", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(string_split(url, '/')) AS parts, length(html) AS chars, upper(substr(url, 1, 4)) AS scheme FROM pages")
def scalar_functions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.split("url", "/")).cast("long").alias("parts"), F.length("html").cast("long").alias("chars"), F.upper(F.substring("url", 1, 4)).alias("scheme"))


@query("pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id")
def pivot(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return rows.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@query("exists_subquery", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def exists_subquery(spark: SparkSession, root: str) -> DataFrame:
    """A correlated subquery; the optimizer turns it into a semi join."""
    orders = table(spark, root, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000")
    return table(spark, root, "customer").where(orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).exists()).select("c_custkey")


@query("theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def theta_join(spark: SparkSession, root: str) -> DataFrame:
    """Pairs by an inequality inside an equal key."""
    a, b = (table(spark, root, "nation").select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias("region"), F.col("n_name").alias(f"name_{c}")) for c in "ab")
    return a.join(b, "region").where("name_a < name_b").select("a", "b")
