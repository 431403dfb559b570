"""Streaming queries over the tables' files, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.plans.core import MERGE_SQL
from loam.sources.scratch import fresh_dir
from loam.streaming import documents as streaming


def _table_stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def stream_split(spark, sf_dir):
    """Packed chunks of the documents as a stream: the same rows as from the table."""
    out = fresh_dir(spark, "stream")
    chunks = streaming.stream_chunks(_table_stream(spark, sf_dir, "documents"), 64)
    chunks.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(chunks.schema).parquet(f"{out}/rows")


def stream_windows(spark, sf_dir):
    """Event counts by hour and type; each batch replaces the windows that it changed in a folder of its own."""
    out = fresh_dir(spark, "stream")
    agg = streaming.event_windows(_table_stream(spark, sf_dir, "events"))
    streaming.each_update(agg, f"{out}/rows", f"{out}/log").awaitTermination()
    rows = streaming.latest(spark.read.schema(agg.schema.add("batch", "long")).parquet(f"{out}/rows"), "start", "event_type")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(spark, sf_dir):
    """Sessions of each user on the table."""
    found = streaming.event_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


SESSIONS_SQL = """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
"""
QUERIES = {"stream_split": stream_split, "stream_windows": stream_windows, "sessions": sessions}
ORACLES = {
    "stream_split": MERGE_SQL,
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sessions": SESSIONS_SQL,
}
