"""Trace events as a stream: counts in windows, and runs that end. An extension; the same aggregates run in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of each step in tumbling windows of ``events(ts, step, field_id)``; events later than ``late`` are left out by the watermark."""
    w = F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(w, "step").agg(F.count("*").alias("n"), F.approx_count_distinct("field_id").alias("fields"))
    return counted.select(F.col("window.start").alias("start"), "step", "n", "fields")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of each field that are less than ``gap`` apart: start, end, events and whether the field was completed."""
    s = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy(s, "field_id").agg(F.count("*").alias("n"), F.max(F.col("step") == "field_completed").alias("completed"))
    return found.select("field_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "completed")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of the same id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
