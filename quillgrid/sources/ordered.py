"""What stands before and after a row in its key's order, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a partition that `by_key` makes.
ROWS = 250_000


def by_key(df: DataFrame, counted: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by `keys` over so many partitions that one has some ROWS (or `rows`) of the rows of `counted`, what df was made of:
    a task's memory stays as it is when the table grows, where partitions that are joined up to a number of bytes hold as many
    small rows as fit."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // (rows or ROWS)))
    return df.repartition(parts, *keys)


def beside(df: DataFrame, key: str, at: str, order: list[str], width: int, value: Column, name: str, after: bool = False) -> DataFrame:
    """df with `name`: `value` of the row before (or `after`) in its `key`'s order (by `at`, then `order`); null for the first.

    Rows are cut by `at` into tiles of `width`; a row looks within its tile, and a tile's first row at the last row of the tile
    before it that has any. So a window holds a tile's rows, or one row for each tile of a key.
    """
    way = F.desc if after else F.asc
    tiles = df.withColumn("_tile", F.floor(F.col(at) / width)).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(key, "_tile").orderBy(way(at), *map(way, order))
    pick = F.min_by if after else F.max_by
    ends = tiles.groupBy(key, "_tile").agg(pick("_value", F.struct(at, *order)).alias("_end"))
    across = Window.partitionBy(key).orderBy(way("_tile"))
    known = ends.select(key, "_tile", F.lag("_end").over(across).alias("_beyond"))
    met = tiles.join(known, [key, "_tile"])
    return met.withColumn(name, F.coalesce(F.lag("_value").over(inside), F.col("_beyond"))["v"]).drop("_tile", "_value", "_beyond")


def latest_start(df: DataFrame, key: str, at: str, order: list[str], width: int, starts: Column, name: str) -> DataFrame:
    """df with `name`: `at` of the last row up to each in its `key`'s order for which `starts` holds, by tiles as in `beside`."""
    tiles = df.withColumn("_tile", F.floor(F.col(at) / width)).withColumn("_start", F.when(starts, F.col(at)))
    across = Window.partitionBy(key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    known = tiles.groupBy(key, "_tile").agg(F.max("_start").alias("_m")).select(key, "_tile", F.max("_m").over(across).alias("_before"))
    inside = Window.partitionBy(key, "_tile").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    return tiles.join(known, [key, "_tile"]).withColumn(name, F.coalesce(F.max("_start").over(inside), F.col("_before"))).drop("_tile", "_start", "_before")


def numbered_within(df: DataFrame, key: str, at: str, order: list[str], width: int, name: str) -> DataFrame:
    """df with `name`: the row's number in its `key`, from 1, by `at` and then `order`; by tiles as in `beside`, so that a key may
    hold any share of the rows."""
    tiles = df.withColumn("_tile", F.floor(F.col(at) / width))
    across = Window.partitionBy(key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = tiles.groupBy(key, "_tile").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_tile", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_tile").orderBy(at, *order)
    return tiles.join(before, [key, "_tile"]).withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_tile", "_before")
