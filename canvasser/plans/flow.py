"""Queries that run the incremental jobs over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.plans.bindings import Views
from canvasser.plans.merging import CHANGES_SQL
from canvasser.plans.registry import query
from canvasser.session import fresh_path
from canvasser.streaming import incremental


def event_stream(v: Views) -> DataFrame:
    """The event table as a file stream."""
    return incremental.read_parquet_stream(v.spark, f"{v.sf_dir}/events.parquet", v.table("events").schema)


def _paths(v: Views, label: str) -> tuple[str, str]:
    """A fresh place for a table, and one for the progress of its query."""
    return fresh_path(v.spark, label), fresh_path(v.spark, f"{label}-progress")


@query(
    "incremental_ingest",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def incremental_ingest(v: Views) -> DataFrame:
    path, progress = _paths(v, "ingest")
    rows = event_stream(v).select("user_id", "event_id", "event_type", "value")
    incremental.incremental_ingest(rows, path, ["user_id"], progress, "event_id", buckets=8).awaitTermination()
    return incremental.read_live(v.spark, path)


@query("cursor_batches", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 50")
def cursor_batches(v: Views) -> DataFrame:
    return incremental.cursor_batch(v.customer.select("c_custkey", "c_name"), "c_custkey", 100, start=50)


@query("cursor_state", """SELECT cast(50 AS bigint) AS start, cast(150 AS bigint) AS "end", cast(150 AS bigint) AS next, 50 + 100 < count(*) AS more FROM customer
    UNION ALL SELECT 0, least(100, count(*)), least(100, count(*)), 100 < count(*) FROM customer""")
def cursor_state(v: Views) -> DataFrame:
    """Where two runs begin and end: one in the middle, one whose stored position is behind all rows."""
    rows = v.customer.select("c_custkey")
    total = rows.agg(F.count("*"))
    spans = incremental.cursor_span(rows, 100, start=50).unionByName(incremental.cursor_span(rows, 100, start=2**40))
    return spans.withColumn("more", F.col("next") < total.scalar())


@query(
    "cursor_stream",
    """WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS spot, count(*) OVER () AS n FROM customer)
    SELECT cast(floor(spot / (floor(n / 3) + 1)) AS bigint) AS run, c_custkey, c_name FROM c
    UNION ALL SELECT 3, c_custkey, c_name FROM c WHERE spot <= floor(n / 3)""",
)
def cursor_stream(v: Views) -> DataFrame:
    """Four runs of a third of the customers and one more row each; the last one begins again."""
    path, progress = _paths(v, "cursor")
    rows = v.customer.select("c_custkey", "c_name")
    for _ in range(4):
        incremental.cursor_stream(rows, "c_custkey", rows.count() // 3 + 1, path, progress).awaitTermination()
    return incremental.read_changes(v.spark, path, rows.schema).withColumnRenamed(incremental.BATCH, "run")


@query("cursor_after", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def cursor_after(v: Views) -> DataFrame:
    """Behind the last key the cursor begins again."""
    rows = v.customer.select("c_custkey", "c_name")
    return incremental.cursor_after(rows, "c_custkey", 100, after=2**62)


@query(
    "progress_dedupe",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events
      WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value < 2) GROUP BY 1, 2""",
)
def progress_dedupe(v: Views) -> DataFrame:
    rows = v.table("events").select("user_id", "event_type", "event_id", "value")
    done = rows.filter("value < 2")
    return incremental.progress_dedupe(rows, done, ["user_id", "event_type"], "event_id").drop("value")


@query(
    "progress_stream",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def progress_stream(v: Views) -> DataFrame:
    path, progress = _paths(v, "seen")
    rows = event_stream(v).select("user_id", "event_type", "event_id")
    incremental.progress_stream(rows, path, ["user_id", "event_type"], progress, "event_id").awaitTermination()
    return incremental.progress_rows(v.spark, path, rows.schema)


@query("streaming_school_activity", "SELECT school_id, count(*) AS activities, max(date) AS latest FROM stream_activities GROUP BY 1")
def streaming_school_activity(v: Views) -> DataFrame:
    path, progress = _paths(v, "activity")
    rows = event_stream(v).select(F.col("user_id").alias("school_id"), F.col("ts").alias("date"))
    incremental.streaming_school_activity(rows, path, progress).awaitTermination()
    return incremental.school_activity(rows, path)


@query("stream_changes", f"WITH {CHANGES_SQL} SELECT * FROM result")
def stream_changes(v: Views) -> DataFrame:
    """The action log as state of a stream, seen over the stored rows."""
    path, progress = _paths(v, "changes")
    kind = F.col("event_type")
    op = F.when(kind == "view", "ADD").when(kind == "error", "DELETE").when(kind == "purchase", "VERIFY").otherwise("UPDATE")
    payload = F.struct(
        F.concat(F.lit("Name "), F.col("event_id").cast("string")).alias("name"), kind.alias("county"),
        (F.col("value") > 50).alias("is_verified"), F.lit(None).cast("timestamp_ntz").alias("last_verified_at"),
    )
    log = event_stream(v).select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("school_id"), payload.alias("payload"), F.col("ts").alias("at")
    )
    incremental.stream_changes(log, path, "school_id", progress).awaitTermination()
    return incremental.changed_rows(v.action_base, log, path, "school_id")
