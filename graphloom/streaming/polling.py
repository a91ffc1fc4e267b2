"""Polling and event windows: which projects are due, and windowed counts of an event stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes between checks.
CHECK_MINUTES = 60


def due_projects(events: DataFrame, now: str, minutes: int = CHECK_MINUTES) -> DataFrame:
    """Projects (user_id) whose last event is at least `minutes` before `now`."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_checked"))
    return last.where(F.col("last_checked") + F.make_dt_interval(mins=F.lit(minutes)) <= F.lit(now).cast("timestamp_ntz")).select("user_id", F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their users in tumbling windows, by type. Works on a stream, where rows later than `late` are dropped, and on a table."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: a gap of `gap` ends one."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str):
    """Write all that a stream has now to Parquet under path and stop; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
