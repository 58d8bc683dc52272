"""Windowed counts over streams, with a bound on how late rows may be.

The functions take a streaming or a batch table alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import clean


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Number and sum of ``value`` per window and ``event_type``; rows later than ``late`` are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def daily_language_lines(entries: DataFrame, late: str = "30 days") -> DataFrame:
    """Lines per day and language as entries arrive; an entry sent again within ``late`` counts once."""
    rows = entries.filter("entry_id is not null and component_path is null and language is not null and lines >= 0")
    rows = rows.withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))
    rows = rows.withWatermark("scanned_at", late).dropDuplicates(["entry_id", "scanned_at"]) if entries.isStreaming else rows.dropDuplicates(["entry_id"])
    grouped = rows.groupBy(F.window("scanned_at", "1 day"), clean(F.col("language")).alias("language")).agg(F.count("*").alias("entries"), F.sum("lines").alias("lines"))
    return grouped.select(F.to_date("window.start").alias("day"), "language", "entries", "lines")
