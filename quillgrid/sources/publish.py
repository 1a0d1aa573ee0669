"""Tables that are replaced as a whole: readers see the old version or the new one, never a part.

A version is written to a folder of its own, read back and compared with what should be there (rows, and a checksum that does
not depend on their order); only then a manifest that names it is written and moved into place, which is the one step that
changes what readers see. A run that ends before leaves a folder that nothing names; `swept` deletes those.

Cases: an empty table is a version like others; without a manifest there is no table (`None`); the manifest with the greatest
number counts, so two writers leave one whole version; a version that differs from what was to be written is never named.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


class Mismatch(RuntimeError):
    """What was written is not what was to be written."""


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, files = _place(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of their hashes: the same in whatever order and however often a task runs."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0))).first()
    return n, total


def published(df: DataFrame, root: str) -> dict:
    """Write df as the new version of the table in `root`; its manifest."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4()}"
    want = digest(df)
    df.write.parquet(f"{root}/{version}")
    got = digest(spark.read.schema(df.schema).parquet(f"{root}/{version}"))
    if got != want:
        raise Mismatch(f"{got[0]} rows of {want[0]}, or other ones, are in {version}")
    last = [n for n in _names(spark, f"{root}/{MANIFESTS}") if n.endswith(".json")]
    number = int(last[-1].split(".")[0]) + 1 if last else 1
    manifest = {"version": version, "rows": want[0], "checksum": want[1], "schema": df.schema.json()}
    staged, files = _place(spark, f"{root}/{MANIFESTS}/{version}.part")
    out = files.create(staged, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final, _ = _place(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    if files.exists(final) or not files.rename(staged, final):  # another writer was first
        raise Mismatch(f"manifest {number} is taken")
    return manifest


def manifest_of(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest of a table."""
    last = [n for n in _names(spark, f"{root}/{MANIFESTS}") if n.endswith(".json")]
    if not last:
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/{MANIFESTS}/{last[-1]}").collect()))


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table's newest whole version."""
    from pyspark.sql.types import StructType

    if (m := manifest_of(spark, root)) is None:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{root}/{m['version']}")


def swept(spark: SparkSession, root: str) -> list[str]:
    """Delete what no manifest names: versions of runs that ended early, and older ones. Names of the deleted folders."""
    m = manifest_of(spark, root)
    gone = [n for n in _names(spark, root) if n.startswith("v-") and (m is None or n != m["version"])]
    for n in gone:
        at, files = _place(spark, f"{root}/{n}")
        files.delete(at, True)
    return gone
