"""Sessions of events as sequences, over tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n_events, items): a user's events with no pause longer than the gap; of a stream, a session comes out once late events can't reach it."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return g.select("user_id", F.col("s.start").alias("start"), "n_events", F.transform("x", lambda e: e["event_type"]).alias("items"))
