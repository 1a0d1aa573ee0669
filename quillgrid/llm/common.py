"""What the operators share: reading a table, cutting lineage in the shared folder, gapless numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a distributed numbering unless told; (keys x buckets) rows of offsets are broadcast.
NUMBER_BUCKETS, BUCKET_ROWS = 1024, 200_000
#: Places a key is met in where it may hold a third of all rows.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, one in the warehouse, which executors share too."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there from now on: a lost executor loses no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there: like `checkpointed`, for tables of which later
    steps read few columns."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}")
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that is read no more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def salted(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """many join one, where a key may have a third of all rows of `many` and has one row of `one`: they meet it in SALTS
    places, by a hash of `spread`."""
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(one, [*keys, "_salt"], how).drop("_salt")


def buckets_for(rows: int) -> int:
    """How many buckets a numbering of so many rows takes: a bucket holds some BUCKET_ROWS, up to a hundred thousand buckets."""
    return max(16, min(100_000, -(-rows // BUCKET_ROWS)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, spread: str | list[str] = "rid", buckets: int = NUMBER_BUCKETS) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within each combination of `keys`, without ever sorting one key's rows in one task.

    keys must have few values (their number times `buckets` rows of offsets are broadcast). Rows are cut into
    buckets by a hash of `spread`, numbered inside (key, bucket) by `order`, and shifted by the rows of the
    buckets before. `order` must be a total order of a bucket's rows, so that a second run gives the same numbers.
    """
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(buckets)).cast("int")).withColumn("_one", F.lit(1))
    keys = keys or ["_one"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return b.join(F.broadcast(offsets), [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_bucket", "_before", "_one")
