"""Frames of a device as a stream: the newest one of each tick, and what else is told from times between frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLL_MS = 160


def milliseconds(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def newest(frames: DataFrame, key: str = "user_id", poll: int = POLL_MS) -> DataFrame:
    """The last frame (ts, event_id) of each key and tick, and how many there were; the same for a batch and a stream."""
    tick = F.floor(milliseconds(F.col("ts")) / poll)
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return frames.groupBy(key, tick.alias("tick")).agg(last, F.count("*").alias("frames")).select(key, "tick", "last.event_id", "last.event_type", "frames")


def stream_newest(frames: DataFrame, folder: str, checkpoint: str, epoch: int, late: str = "1 second"):  # noqa: ANN201
    """Write the newest frame of each closed tick of the running epoch as Parquet. Frames of former epochs are stale and
    left out; ticks are windows, closed by the watermark, so state is as large as what is open."""
    live = frames.where(F.col("epoch") == epoch).withWatermark("ts", late)
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    ticks = live.groupBy("user_id", F.window("ts", f"{POLL_MS} milliseconds")).agg(last, F.count("*").alias("frames"))
    out = ticks.select("user_id", F.col("window.start").alias("tick"), "last.event_id", "last.event_type", "frames")
    return out.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
