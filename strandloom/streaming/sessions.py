"""Gap clustering on time for streams: the session form of the island operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n_events) of a batch or a stream of (user_id, ts, ...).

    On a stream, sessions that the watermark has passed are final; later events are dropped.
    """
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
