"""Debouncing: of requests that follow one another within a pause, only the last is carried out, when the pause is over.

The same function serves a table and a stream: requests at most PAUSE apart are one session window. On a stream, sessions are
told when the watermark has passed their end; a request that comes later than the watermark is dropped, so what was told
never changes.

Cases: requests with a null key or time take no part; of requests at one time the one with the greatest id counts as the last;
repeated rows are requests of their own; a request exactly PAUSE after the one before belongs to its session; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAUSE = "150 milliseconds"


def debounced(requests: DataFrame, key: str = "user_id", pause: str = PAUSE, late: str | None = None) -> DataFrame:
    """(key, begin, due, event_id, requests): each session, when its last request is due, which it is, and how many there were.
    late: for streams, how far the watermark stays behind the latest request."""
    known = requests.select(key, F.col("ts").cast("timestamp").alias("ts"), "event_id").dropna(subset=[key, "ts"])
    if late is not None:
        known = known.withWatermark("ts", late)
    session = known.groupBy(key, F.session_window("ts", pause).alias("session"))
    told = session.agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("requests"))
    return told.select(key, F.col("session.start").alias("begin"), F.col("session.end").alias("due"), F.col("last.event_id").alias("event_id"), "requests")
