"""Queries that write to the shared folder and read back: XML documents, JSON diagnostics, a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import diagnostics, timelines, xml
from tidemark.sources.shared import fresh_folder
from tidemark.sources.tables import table
from tidemark.streaming import silences
from tidemark.streaming.density import density


@query("xml_round_trip", "SELECT event_id, event_type || ' & <' || props || '>' AS name, value FROM events WHERE event_type = 'purchase'")
def xml_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Purchases as clips of a timeline, written as XML with names that need escapes, and read again."""
    clips = table(spark, root, "events").where("event_type = 'purchase'").select("event_id", F.concat("event_type", F.lit(" & <"), "props", F.lit(">")).alias("name"), "value")
    path = fresh_folder(spark, "xml")
    xml.write_rows(clips, path, "sequence", "clip")
    return xml.read_rows(spark, path, "clip", clips.schema)


@query(
    "diagnostics",
    "SELECT 'nation ' || n_name AS component, CASE n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_checked' ELSE 'needs_attention' END AS status, CASE n_nationkey % 3 WHEN 0 THEN TRUE WHEN 2 THEN FALSE END AS healthy FROM nation",
)
def read_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """Nations as components with one of three states, written as JSON and read again."""
    state = F.element_at(F.array(F.lit("ok"), F.lit("not_checked"), F.lit("needs_attention")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    path = fresh_folder(spark, "diagnostics")
    table(spark, root, "nation").select(F.concat(F.lit("nation "), "n_name").alias("component"), state.alias("status")).write.json(path)
    return diagnostics.read_diagnostics(spark, path).select("component", "status", "healthy")


@query("density_stream", "SELECT * FROM (SELECT date_trunc('day', ts) AS t0, event_type, count(*) AS n_events FROM events GROUP BY ALL) WHERE t0 + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def density_stream(spark: SparkSession, root: str) -> DataFrame:
    """``event_density`` on a stream of the table's files: the windows that the watermark has passed once all is read."""
    events = spark.readStream.schema(table(spark, root, "events").schema).option("pathGlobFilter", "events.parquet").parquet(root)
    path = fresh_folder(spark, "stream")
    stream = density(events, "ts", "1 day", late="10 minutes", keys=["event_type"])
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema("t0 timestamp, t1 timestamp, event_type string, n_events long").parquet(f"{path}/rows")
    return found.select(F.to_timestamp_ntz(F.date_format("t0", "yyyy-MM-dd HH:mm:ss")).alias("t0"), "event_type", "n_events")


#: Seconds that part two islands of events, how far the watermark of the stream is behind, and the rows that one task with state may get.
APART, LATE, TASK_ROWS = 21600, "1 hour", 4_000_000


def _state_tasks(spark: SparkSession, n: int) -> int:
    """In how many tasks the state of a stream of ``n`` rows is kept: each runs Python and opens a store in every batch, so one for each core if that is enough."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


@query(
    "silence_stream",
    """
    WITH e AS (SELECT user_id, date_trunc('second', ts) AS t FROM events), w AS (SELECT max(t) - INTERVAL 1 HOUR AS w FROM e),
         f AS (SELECT user_id, t, lag(t) OVER o AS before, CASE WHEN t - lag(t) OVER o > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t)),
         i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM f),
         k AS (SELECT user_id, 'island' AS kind, CAST(island AS BIGINT) AS island, min(t) AS t0, max(t) AS t1, count(*) AS n_events FROM i GROUP BY user_id, island)
    SELECT user_id, kind, island, t0, t1, n_events FROM k, w WHERE t1 + INTERVAL 6 HOUR < w
    UNION ALL SELECT user_id, 'silence', CAST(island AS BIGINT), before, t, NULL FROM i, w WHERE fresh = 1 AND t < w
    """,
)
def silence_stream(spark: SparkSession, root: str) -> DataFrame:
    """Islands and silences of events that come by fortnights: each is a run of the stream that goes on from the last one's checkpoint."""
    events = table(spark, root, "events").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    path = fresh_folder(spark, "silences")
    first, last, n = events.agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    found = None
    store, tasks = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (store, tasks)}
    spark.conf.set(store, silences.PROVIDER)
    spark.conf.set(tasks, _state_tasks(spark, n))
    try:
        for part in range((last - first).days // 14 + 1 if first else 0):
            begin = F.lit(first) + F.make_dt_interval(F.lit(14 * part))
            events.where((F.col("ts") >= begin) & (F.col("ts") < begin + F.make_dt_interval(F.lit(14)))).write.mode("append").parquet(f"{path}/events")
            stream = silences.silence_stream(spark.readStream.schema(events.schema).parquet(f"{path}/events"), ["user_id"], "ts", APART, LATE)
            stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            found = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    finally:
        for c in before:
            spark.conf.set(c, before[c])
    plain = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss")).alias(c)
    none = spark.createDataFrame([], "user_id long, kind string, island long, t0 timestamp, t1 timestamp, n_events long")
    return (none if found is None else found).select("user_id", "kind", "island", plain("t0"), plain("t1"), "n_events")


@query(
    "timeline_documents",
    """
    SELECT CAST(user_id AS VARCHAR) AS sequence_id, CAST(dense_rank() OVER (ORDER BY event_type) AS INT) AS track, event_type AS kind, CAST(event_id AS VARCHAR) AS clip_id, ' <' || props || '> & ' AS name,
           date_diff('second', TIMESTAMP '2024-01-01', ts) AS t0, date_diff('second', TIMESTAMP '2024-01-01', ts) + 60 AS t1, 'take ' || event_type AS path FROM events
    """,
)
def timeline_documents(spark: SparkSession, root: str) -> DataFrame:
    """Users as sequences, kinds of events as tracks, events as clips: each user's document is written, read and taken apart."""
    events = table(spark, root, "events")
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    number = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    t0 = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    own = events.select(F.col("user_id").cast("string").alias("sequence_id"), number.alias("track"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("clip_id"), F.concat(F.lit(" <"), "props", F.lit("> & ")).alias("name"), t0.alias("t0"))
    per_kind = own.select("sequence_id", "track", "kind").distinct()
    built = timelines.documents(timelines.Timelines(
        own.select("sequence_id").distinct().select("sequence_id", F.concat(F.lit("user "), "sequence_id").alias("name"), F.lit(25).alias("timebase"), F.lit(False).alias("ntsc")),
        per_kind, own.select("sequence_id", "track", "clip_id", F.col("kind").alias("file_id"), "name", "t0", (F.col("t0") + 60).alias("t1"), F.lit(0).cast("long").alias("t_in")),
        per_kind.select("sequence_id", F.col("kind").alias("file_id"), F.concat(F.lit("take "), "kind").alias("path"), F.lit(None).cast("long").alias("duration")),
    ))
    path = fresh_folder(spark, "timelines")
    built.write.parquet(path)
    read = timelines.tables(spark.read.schema(built.schema).parquet(path))
    return read.clips.join(read.tracks, ["sequence_id", "track"]).join(read.files, ["sequence_id", "file_id"]).select("sequence_id", "track", "kind", "clip_id", "name", "t0", "t1", "path")
