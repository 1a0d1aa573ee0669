"""Worker events as a stream: latest-wins folding by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event (by ts, then event_id) of each key; the same for a batch and for a stream in update mode."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return events.groupBy(key).agg(last, F.count("*").alias("n")).select(key, "last.event_id", "last.event_type", "n")


def fold_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):  # noqa: ANN001, ANN201
    """Run all available parquet files of a folder through `latest` in update mode: each batch writes the keys it changed to
    a folder of its own, so that a batch run again after a failure writes the same place. See `folded`."""
    stream = latest(spark.readStream.schema(schema).parquet(folder))
    write = lambda changed, batch: changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, out: str, key: str = "user_id") -> DataFrame:
    """What a stream wrote last for each key."""
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in others])
