"""Event-time windows that work the same on streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, kind: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling hours, hours sliding by 30 minutes, or sessions of a user with gaps of up to 2 hours.

    On a stream, rows later than the watermark are left out; a table has all of them.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    window = {"tumbling": lambda: F.window("at", "1 hour"), "sliding": lambda: F.window("at", "1 hour", "30 minutes"), "session": lambda: F.session_window("at", "2 hours")}[kind]()
    key = F.col("user_id") if kind == "session" else F.col("event_type")
    out = timed.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")
