"""Event-time windows, for batch and streaming input alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, started, ended, n): runs of events no further apart than ``gap``; ``ended`` is the last event."""
    rows = events.withWatermark("ts", late) if late else events
    # A window closes at the gap, so an event exactly there opens a new one; a microsecond keeps it in.
    wide = F.session_window("ts", F.lit(f"{gap} 1 microsecond"))
    return rows.groupBy("user_id", wide).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session_window")


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(started, event_type, n, total) by fixed or sliding windows."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")
