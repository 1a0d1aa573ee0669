"""Queries of what streams tell: frames that are looked at, silences, the first hit, requests that were waited for.

The events of a day and of a seventh of the users are a device's; a device's clock runs 500 to 32,000 times as fast, so that frames
come from many a second to one in minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import sessions, watch
from .catalog import query

FRAMES = "f AS (SELECT CAST(user_id % 7 + 7 * (epoch_us(ts) // 86400000000) AS BIGINT) AS device, epoch_us(ts) // (500 * CAST(2 ** (user_id % 7) AS BIGINT)) AS us, event_id, event_type = 'purchase' AND event_id % 16 = 0 AS hit FROM events)"


def frames(events: DataFrame) -> DataFrame:
    """(device, ts, event_id, hit) of a table or stream of events."""
    us, seventh = F.unix_micros(F.col("ts").cast("timestamp")), F.col("user_id") % 7
    device = seventh + 7 * F.floor(us / 86_400_000_000)
    fast = F.floor(us / (F.pow(F.lit(2), seventh) * 500)).cast("long")
    return events.select(device.cast("long").alias("device"), F.timestamp_micros(fast).alias("ts"), "event_id", ((F.col("event_type") == "purchase") & (F.col("event_id") % 16 == 0)).alias("hit"))


@query(f"""WITH RECURSIVE {FRAMES}, n AS (SELECT *, row_number() OVER w AS i, lead(us) OVER w AS next FROM f WINDOW w AS (PARTITION BY device ORDER BY us, event_id)),
j AS (SELECT a.device, a.i, min(b.i) AS k FROM n a JOIN n b ON b.device = a.device AND b.us >= a.us + {watch.THROTTLE} GROUP BY ALL),
t AS (SELECT device, i FROM n WHERE i = 1 UNION ALL SELECT t.device, j.k FROM t JOIN j ON j.device = t.device AND j.i = t.i),
taken AS (SELECT n.* FROM t JOIN n USING (device, i)), e AS (SELECT device, min(i) AS last FROM taken WHERE hit GROUP BY device), u AS (SELECT max(us) AS until FROM f)
SELECT device, CASE WHEN hit THEN 'match' ELSE 'taken' END AS kind, us, event_id FROM taken LEFT JOIN e USING (device) WHERE i <= coalesce(last, i)
UNION ALL SELECT device, 'silent', us + {watch.SILENCE}, NULL FROM n LEFT JOIN e USING (device), u WHERE i < coalesce(last, i + 1) AND CASE WHEN next IS NULL THEN until - us >= {watch.SILENCE} ELSE next - us > {watch.SILENCE} END""")
def frame_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = watch.watched(frames(table(spark, sf_dir, "events")))
    return told.select("device", "kind", F.unix_micros("at").alias("us"), "event_id")


@query(f"""WITH {FRAMES}, s AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 150000 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY device ORDER BY us, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY us, event_id) AS run FROM s)
SELECT device, min(us) AS begin_us, max(us) + 150000 AS due_us, arg_max(event_id, [us, event_id]) AS event_id, count(*) AS requests FROM g GROUP BY device, run""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sessions.debounced(frames(table(spark, sf_dir, "events")), key="device")
    return told.select("device", F.unix_micros("begin").alias("begin_us"), F.unix_micros("due").alias("due_us"), "event_id", "requests")
