"""Watching the frames of devices: one in 300 ms is looked at, a silence of 10 s is told, and the first hit ends it.

Frames are rows (device, ts, event_id, hit). `watched` tells of a table, `watch` of a stream, in the same rows (device, kind, at,
event_id): `taken` for a frame that is looked at (the first one, and then each that comes at least THROTTLE after the one looked
at before), `match` for the first of those that is a hit, after which the device is closed and nothing more is told of it, and
`silent` where SILENCE went by after a frame without another one.

Cases: frames of one time go by event_id; repeated rows are frames of their own; frames with a null device, time or event_id
take no part; a null hit is none; a device without a later frame is silent if `until` (for a stream, its watermark) is past the
10 s; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..sources.ordered import beside, latest_start

#: Microseconds.
THROTTLE, SILENCE = 300_000, 10_000_000
TILE = 600_000_000
TOLD = "device long, kind string, at timestamp, event_id long"


def _frames(frames: DataFrame) -> DataFrame:
    known = frames.select(F.col("device").cast("long").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return known.dropna(subset=["device", "ts", "event_id"])


def watched(frames: DataFrame, until: int | None = None) -> DataFrame:
    """What is told of a table of frames. until: microseconds of the time up to which silence is known (else the last frame's).

    Frames less than THROTTLE apart make a burst; the first of a burst is always taken, so bursts are folded on their own, as
    one array each. No window or group holds more than a tile of a device's time, or a burst.
    """
    f = _frames(frames).withColumn("us", F.unix_micros("ts"))
    if until is None:
        until = f.agg(F.max("us")).first()[0]
    f = beside(f, "device", "us", ["event_id"], TILE, F.col("us"), "before")
    f = beside(f, "device", "us", ["event_id"], TILE, F.col("us"), "next", after=True)
    first = F.col("before").isNull() | (F.col("us") - F.col("before") >= THROTTLE)
    f = latest_start(f, "device", "us", ["event_id"], TILE, first, "burst")
    row = F.struct("us", "event_id", "hit")
    bursts = f.groupBy("device", "burst").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<us: bigint, event_id: bigint, hit: boolean>>").alias("taken"))
    fold = lambda s, x: F.when(s["last"].isNull() | (x["us"] - s["last"] >= THROTTLE), F.struct(x["us"].alias("last"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)
    taken = bursts.select("device", F.explode(F.aggregate("rows", none, fold)["taken"]).alias("x")).select("device", "x.*")
    closed = taken.where("hit").groupBy("device").agg(F.min(F.struct("us", "event_id")).alias("end"))
    told = taken.join(closed, "device", "left").where(F.col("end").isNull() | (F.struct("us", "event_id") <= F.col("end")))
    told = told.select("device", F.when(F.col("hit"), "match").otherwise("taken").alias("kind"), "us", "event_id")
    gap = F.coalesce("next", F.lit(until)) - F.col("us")
    quiet = F.when(F.col("next").isNull(), gap >= SILENCE).otherwise(gap > SILENCE)
    silent = f.where(quiet).select("device", "us", "event_id").join(closed, "device", "left").where(F.col("end").isNull() | (F.struct("us", "event_id") < F.col("end")))
    silent = silent.select("device", F.lit("silent").alias("kind"), (F.col("us") + SILENCE).alias("us"), F.lit(None).cast("long").alias("event_id"))
    return told.unionByName(silent).select("device", "kind", F.timestamp_micros("us").alias("at"), "event_id")


class Watch(StatefulProcessor):
    """A device's frames wait until the watermark has passed them, so that they are told in their order whatever the batch they
    come in. State: the times of the last frame taken and seen, whether its silence was told, and what waits; of a closed
    device only that it is closed. Timers are for the first frame that waits and for the end of a silence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "taken long, seen long, quiet boolean")
        self.closed = handle.getValueState("closed", "closed boolean")
        self.waiting = handle.getListState("waiting", "us long, event_id long, hit boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.closed.exists():
            first = None
            for part in rows:
                us = part["ts"].astype("datetime64[us]").astype("int64")
                self.waiting.appendList([(int(t), int(i), bool(h)) for t, i, h in zip(us, part["event_id"], part["hit"])])
                first = min(us.min(), first if first is not None else us.min())
            if first is not None:
                self._wake(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.closed.exists():
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        taken, seen, quiet = self.last.get() if self.last.exists() else (None, None, False)
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        told, end = [], False
        for us, event_id, hit in ready:
            if seen is not None and us - seen > SILENCE and not quiet:
                told.append(("silent", seen + SILENCE, None))
            seen, quiet = us, False
            if taken is None or us - taken >= THROTTLE:
                taken = us
                told.append(("match" if hit else "taken", us, event_id))
                if end := hit:
                    break
        if not end and seen is not None and not quiet and now >= seen + SILENCE and not (later and later[0][0] <= seen + SILENCE):
            told.append(("silent", seen + SILENCE, None))
            quiet = True
        self.waiting.clear()
        if end:
            self.last.clear()
            self.closed.update((True,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            self.last.update((taken, seen, quiet))
            if later:
                self.waiting.put(later)
                self._wake(later[0][0])
            if seen is not None and not quiet:
                self._wake(seen + SILENCE)
        if told:
            kind, at, ids = zip(*told)
            yield pd.DataFrame({"device": [key[0]] * len(told), "kind": kind, "at": pd.to_datetime(list(at), unit="us", utc=True).tz_localize(None), "event_id": pd.array(ids, dtype="Int64")})

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def watch(frames: DataFrame, late: str = "1 second") -> DataFrame:
    """What is told of a stream of frames, each when the watermark (`late` behind the latest frame of all) has passed it.
    Frames that come when it has passed them already are dropped. Sessions that run this need the RocksDB state store."""
    live = _frames(frames).withWatermark("ts", late)
    return live.groupBy("device").transformWithStateInPandas(Watch(), TOLD, "Append", "EventTime")


def written(told: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of what is told, as Parquet files; after a restart it goes on where the checkpoint says."""
    return told.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True)
