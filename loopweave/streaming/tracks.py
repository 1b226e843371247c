"""Track summaries over streams of events: an extension, as circular tracks are complete by nature.

A stream's track is linear.  Counts by label and time window are kept as state
until the watermark passes the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(name, start, label, n)`` of a stream ``(name, ts, label)``: events by name, time window and label."""
    span = F.window("ts", window)
    counts = events.withWatermark("ts", late).groupBy("name", span.alias("w"), "label").agg(F.count("*").alias("n"))
    return counts.select("name", F.col("w.start").alias("start"), "label", "n")
