"""Masks over pictures: rows (image, y, x, ...) with boolean or 0-255 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .regions import neighbourhood

#: Classes of a label map (fixed values): hair, face and limbs are kept; limbs alone are skin; hair, face and hats are identity.
KEPT, SKIN, IDENTITY = (2, 3, 11, 12, 13, 14, 15), (12, 13, 14, 15), (2, 3, 11)
SIDES_4 = ((0, 1), (0, -1), (1, 0), (-1, 0))
SIDES_8 = (*SIDES_4, (1, 1), (1, -1), (-1, 1), (-1, -1))


def spread(mask: DataFrame, sides: tuple = SIDES_4) -> DataFrame:
    """mask (image, y, x) with label: the least place (y, x) of its connected part, spread until nothing changes."""
    state = mask.select("image", "y", "x", F.struct("y", "x").alias("label")).checkpoint()
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), *sides)])
    while True:
        sent = state.withColumn("s", F.explode(steps)).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label")
        near = sent.groupBy("image", "y", "x").agg(F.min("label").alias("near"))
        jump = state.select("image", F.col("y").alias("near_y"), F.col("x").alias("near_x"), F.col("label").alias("further"))
        met = state.join(near, ["image", "y", "x"]).withColumn("near_y", F.col("near.y")).withColumn("near_x", F.col("near.x"))
        after = met.join(jump, ["image", "near_y", "near_x"]).select("image", "y", "x", F.col("label").alias("old"), F.least("near", "further").alias("label")).checkpoint()
        state = after.drop("old")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return state


def part_statistics(parts: DataFrame) -> DataFrame:
    """Area, box and sums of places of each part of `spread`."""
    return parts.groupBy("image", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")
    )


def border_parts(mask: DataFrame, width: int, height: int) -> DataFrame:
    """The pixels of a mask that are connected, side by side, with the picture's border."""
    parts = spread(mask)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    seeds = parts.where(edge).select("image", "label").distinct()
    return parts.join(seeds, ["image", "label"], "left_semi").select("image", "y", "x")


def with_redaction(pixels: DataFrame, left: int, top: int, right: int, bottom: int, effect: str, strength: int, name: str, fill: int = 0) -> DataFrame:
    """pixels (image, y, x, v, ...) with `name`: v, where a rectangle is filled, or replaced by block means, or blurred by two
    clipped means of `strength`. What is worked on is the rectangle and `strength` pixels around it.

    Pixels are never joined or sent twice: a block's mean, and the means along a row and down a column of a picture, are windows
    of a block, a row or a column.
    """
    size = max(1, strength)
    near = F.col("x").between(left - size, right - 1 + size) & F.col("y").between(top - size, bottom - 1 + size)
    inside = F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1)
    seen = F.when(near, F.col("v"))
    if effect == "solid":
        return pixels.withColumn(name, F.when(inside, fill).otherwise(F.col("v")))
    mean = lambda value, w: F.floor(F.sum(value).over(w) / F.count(value).over(w)).cast("int")
    if effect == "mosaic":
        # blocks begin at the corner of what is worked on
        x0, y0 = max(0, left - size), max(0, top - size)
        block = Window.partitionBy("image", F.floor((F.col("y") - y0) / size), F.floor((F.col("x") - x0) / size))
        return pixels.withColumn(name, F.when(inside, mean(seen, block)).otherwise(F.col("v")))
    radius = max(1, strength // 2)
    along = lambda a, b: Window.partitionBy("image", a).orderBy(b).rangeBetween(-radius, radius)
    rows = pixels.withColumn("_row", F.when(near, mean(seen, along("y", "x"))))
    return rows.withColumn(name, F.when(inside, mean(F.col("_row"), along("x", "y"))).otherwise(F.col("v"))).drop("_row")


def redacted(pixels: DataFrame, left: int, top: int, right: int, bottom: int, effect: str, strength: int, fill: int = 0) -> DataFrame:
    """(image, y, x, v) with a rectangle filled, or replaced by block means, or blurred: see `with_redaction`."""
    return with_redaction(pixels, left, top, right, bottom, effect, strength, "_new", fill).select("image", "y", "x", F.col("_new").alias("v"))


def material_masks(labels: DataFrame) -> DataFrame:
    """(image, y, x, label) with background and cloth: 255 or 0, both away from what is kept by a guard of five pixels."""
    kept = labels.select("image", "y", "x", "label", F.col("label").isin(*KEPT).cast("int").alias("v"))
    guard = neighbourhood(kept.select("image", "y", "x", "v"), 5, grow=True).withColumnRenamed("v", "guard")
    told = kept.join(guard, ["image", "y", "x"])
    allowed = F.col("guard") == 0
    full = lambda c: F.when(c & allowed, 255).otherwise(0)
    return told.select("image", "y", "x", full(F.col("label") == 0).alias("background"), full((F.col("v") == 0) & (F.col("label") != 0)).alias("cloth"))


def skin_mask(labels: DataFrame, wanted: Column) -> DataFrame:
    """(image, y, x, allowed): limbs three pixels inside their outline, five away from identity, where `wanted`."""
    one = lambda classes: F.col("label").isin(*classes).cast("int").alias("v")
    inner = neighbourhood(labels.select("image", "y", "x", one(SKIN)), 3, grow=False).withColumnRenamed("v", "inner")
    face = neighbourhood(labels.select("image", "y", "x", one(IDENTITY)), 5, grow=True).withColumnRenamed("v", "face")
    told = labels.join(inner, ["image", "y", "x"]).join(face, ["image", "y", "x"])
    return told.select("image", "y", "x", ((F.col("inner") > 0) & (F.col("face") == 0) & wanted).alias("allowed"))


def palette(light: Column, cb: Column, cr: Column) -> list[Column]:
    """Red, green and blue of a luminance with colour differences, these only as strong as the gamut lets them be."""
    offsets = [cr * 1.402, cb * -0.344136 - cr * 0.714136, cb * 1.772]
    room = [F.when(o >= 0, (255 - light) / F.greatest(o, F.lit(1e-5))).otherwise(light / F.greatest(-o, F.lit(1e-5))) for o in offsets]
    much = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(*room)))
    return [F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), light + o * much))).cast("int") for o in offsets]
