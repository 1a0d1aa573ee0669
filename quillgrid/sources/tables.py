"""Readers of the driver tables, and the gray raster they are looked at as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): one row of 64 gray values 0-255 for each embedding, rounded half up."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "f"))
    return e.select("y", "x", F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("f").cast("double") + 1) * 127.5 + 0.5))).cast("int").alias("v"))


def ranked(df: DataFrame, key: str, order: list[str], name: str, buckets: int = 1024, group: str | None = None) -> DataFrame:
    """df with its rows' numbers 0, 1, ... by (key, order), within each `group` (of which there are few) if one is named.
    They are counted by ranges of an integer key so that no task sorts all rows, nor a group's; `buckets` rows of offsets
    (for each group) are broadcast."""
    groups = [group] if group else []
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    cut = df.withColumn("_b", F.floor((F.col(key) - F.lit(low or 0)) / width).cast("int"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*groups, "_b").agg(F.count("*").alias("_n")).select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*groups, "_b").orderBy(key, *order)
    return cut.join(F.broadcast(offsets), [*groups, "_b"]).withColumn(name, F.col("_o") + F.row_number().over(inside) - 1).drop("_b", "_o")
