"""Spreading known offsets over a picture: a smooth field that agrees with what is known, by bounded rounds of relaxation.

Pictures are rows of arrays (image, y, offset), null where the offset is not known. An unknown one becomes the mean of its
neighbours above, below, left and right (those that the picture has), again and again: after `rounds` steps, or when no value of
a picture moves by more than `still`, the field stands. Known offsets never change.

A picture is cut into tiles of TILE_ROWS rows. A round sends each tile the STEPS rows on either side of it and takes STEPS
steps within an array expression, so that one shuffle of tile edges serves STEPS steps, exactly as steps over the whole picture
would. Pictures that stand leave the rounds.

Cases: a picture without known offsets stands at 0; one without unknown ones stands at once; rows of one picture have one
length, each y once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_ROWS, STEPS = 128, 8


def _stepped(field: Column, known: Column) -> Column:
    """One step over the rows of an array of arrays: every unknown value becomes the mean of its neighbours."""

    def value(i: Column, j: Column, row: Column) -> Column:
        up, down = F.get(F.get(field, i - 1), j), F.get(F.get(field, i + 1), j)
        left, right = F.get(row, j - 1), F.get(row, j + 1)
        zero = F.lit(0.0)
        near = [up, down, left, right]
        total = F.coalesce(up, zero) + F.coalesce(down, zero) + F.coalesce(left, zero) + F.coalesce(right, zero)
        there = sum((n.isNotNull().cast("int") for n in near[1:]), near[0].isNotNull().cast("int"))
        return F.when(there > 0, total / there).otherwise(F.get(row, j))

    return F.transform(field, lambda row, i: F.transform(row, lambda v, j: F.when(F.get(F.get(known, i), j), v).otherwise(value(i, j, row))))


def spread(rows: DataFrame, rounds: int = 64, still: float = 1e-3) -> DataFrame:
    """(image, y, offset, residual): the field, and by how much its picture moved in the last step. Lineage is cut after each
    round; only whether any picture still moves comes to the driver."""
    tile = F.floor(F.col("y") / TILE_ROWS)
    v = F.transform("offset", lambda o: F.coalesce(o.cast("double"), F.lit(0.0)))
    cells = rows.select("image", "y", v.alias("v"), F.transform("offset", lambda o: o.isNotNull()).alias("k"))
    state = cells.withColumn("residual", F.lit(None).cast("double")).checkpoint()
    done, left = None, rounds
    while left > 0:
        steps = min(STEPS, left)
        left -= steps
        near = F.array_distinct(F.array(tile, F.floor((F.col("y") - steps) / TILE_ROWS), F.floor((F.col("y") + steps) / TILE_ROWS)))
        held = state.select("image", F.explode(near).alias("tile"), F.struct("y", "v", "k").alias("r")).groupBy("image", "tile").agg(F.sort_array(F.collect_list("r")).alias("r"))
        known = F.transform("r", lambda x: x["k"])
        start = F.struct(F.transform("r", lambda x: x["v"]).alias("v"), F.transform("r", lambda x: x["v"]).alias("before"))
        run = held.select("image", "tile", "r", known.alias("k"), start.alias("s"))
        run = run.select("image", "tile", "r", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("s"), lambda s, _: F.struct(_stepped(s["v"], F.col("k")).alias("v"), s["v"].alias("before"))).alias("s"))
        rows_now = run.select("image", "tile", F.posexplode("r").alias("i", "r"), "s").select("image", "tile", F.col("r.y").alias("y"), F.get("s.v", F.col("i")).alias("v"), F.col("r.k").alias("k"), F.get("s.before", F.col("i")).alias("b"))
        moved = F.array_max(F.zip_with("v", "b", lambda a, b: F.abs(a - b)))
        own = rows_now.where(tile == F.col("tile")).select("image", "y", "v", "k", F.coalesce(moved, F.lit(0.0)).alias("moved")).checkpoint()
        most = own.groupBy("image").agg(F.max("moved").alias("residual"))
        after = own.join(most, "image").select("image", "y", "v", "k", "residual").checkpoint()
        stands = (F.col("residual") <= still) if left else F.lit(True)
        ended = after.where(stands)
        done = ended if done is None else done.unionByName(ended)
        state = after.where(~stands)
        if not left or state.isEmpty():
            break
    if done is None:
        done = state
    return done.select("image", "y", F.col("v").alias("offset"), "residual")
