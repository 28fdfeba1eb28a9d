"""Event-time operators for streams (event_id, ts, user_id, event_type); the same functions work on tables.

State is bounded by the watermark: windows, sessions and keys older than it are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "10 minutes"


def rates(events: DataFrame, *, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """event_type, window_start and n: events of each type in sliding windows."""
    seen = events.withWatermark("ts", LATENESS).groupBy("event_type", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return seen.select("event_type", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, *, gap: str = "6 hours") -> DataFrame:
    """user_id, session_start and n: a session ends when its user has no event for `gap`."""
    seen = events.withWatermark("ts", LATENESS).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return seen.select("user_id", F.col("w.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each value of `keys`; on a stream, of those within the watermark of each other."""
    if events.isStreaming:
        return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def write_available(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to a Parquet folder; started again with the same checkpoint it goes on where it stopped."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
