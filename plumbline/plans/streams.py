"""Queries over ``events`` as a stream that is read to its end: windows, sessions, and the latest row of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import shared_dir, table
from plumbline.streaming import checkpoints as K

#: Files that a trigger reads.
FILES = 100


def events(spark: SparkSession, d: str) -> DataFrame:
    # A pattern, as a stream's path that is no pattern must be a folder, and the table may be one file.
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", FILES).parquet(f"{d}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _places(spark: SparkSession, name: str) -> tuple[str, str]:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{path}/table", f"{path}/state"


def stream_windows(spark, d):
    """Sums of values by day and event type, by sliding windows of two days."""
    out = K.spend_by_window(events(spark, d), "ts", "value", "2 days", "1 day", by=("event_type",))
    own = K.drained(out, *_places(spark, "windows"))
    return own.select(F.col("window.start").cast("string").alias("start"), "event_type", F.round("total", 4).alias("total"), "n")


def stream_sessions(spark, d):
    """Sessions of each user: events that follow one another within six hours."""
    own = K.drained(K.sessions(events(spark, d), "ts", "user_id", "6 hours"), *_places(spark, "sessions"))
    return own.select("user_id", F.col("session_window.start").cast("string").alias("start"), F.col("session_window.end").cast("string").alias("end"), "n")


def stream_latest(spark, d):
    """The latest event of each user and type, kept by upserts."""
    path, state = _places(spark, "latest")
    K.upsert_to(events(spark, d), path, ["user_id", "event_type"], "event_id", state).awaitTermination()
    return K.current(spark, path, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_latest)}

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SQL = {
    "stream_windows": f"""WITH e AS (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events WHERE ts IS NOT NULL)
SELECT {_TIME.format('s')} AS start, event_type, round(sum(value), 4) AS total, count(*) AS n FROM e GROUP BY s, event_type""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::VARCHAR AS start, (max(ts) + INTERVAL 6 HOUR)::VARCHAR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
}
