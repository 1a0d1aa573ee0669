"""Files as rows: what lies below a folder, with their content only where it is asked for and small enough.

Cases: a folder without files gives no rows; paths that differ only in case are one file, the first by name; a depth of 0 is
the folder itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def discovered(spark: SparkSession, root: str, name: str = "*", depth: int = 2) -> DataFrame:
    """(path, name, depth, length, modified) of the files below a folder whose names fit, at most so many folders deep. The
    listing is all that is read: no content column is."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    base = F.regexp_replace(F.lit(root), "/+$", "")
    # the listing names the file system, a caller may not
    below = F.regexp_replace(F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), F.regexp_replace(base, "^[a-z]+:/+", "/"), F.lit("\\E/")), 2), -1), "^/+", "")
    told = found.select("path", below.alias("name"), F.size(F.split(below, "/")).alias("depth") - 1, "length", F.col("modificationTime").alias("modified"))
    told = told.toDF("path", "name", "depth", "length", "modified").where(F.col("depth") <= depth)
    same = Window.partitionBy(F.lower("path")).orderBy("path")
    return told.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def contents(spark: SparkSession, root: str, name: str = "*", most: int = 32_000_000) -> DataFrame:
    """(path, length, content, too_large): the files below a folder. What is larger than `most` has no content: sizes are known from
    the listing, and a larger file is not opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    small = found.where(F.col("length") <= most).select("path", "length", "content", F.lit(False).alias("too_large"))
    large = found.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("too_large"))
    return small.unionByName(large)
