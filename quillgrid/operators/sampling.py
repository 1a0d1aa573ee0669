"""Reading the squares of a code from a picture: its corners give a projective map, by which each square looks up one pixel.

Codes are rows (image, code, side, x0, y0, ... x3, y3): the places in the picture of the middles of the corner markers (upper left,
upper right, lower left) and of the fourth point that the map sends there, or null; then it is where the three put it (a
parallelogram). side: squares along an edge. A marker's middle is 3.5 squares from both edges.

Cases: a square whose pixel lies outside its picture is unknown (null); codes with a null corner, and those whose four points
lie on a line, have only unknown squares; equal codes are read each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIDDLE = 3.5


def projective(x: list[Column], y: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    """Where (u, v) of the unit square lies, whose corners (0,0), (1,0), (0,1), (1,1) lie at the four places."""
    sx, sy = x[0] - x[1] + x[3] - x[2], y[0] - y[1] + y[3] - y[2]
    ax, ay, bx, by = x[1] - x[3], y[1] - y[3], x[2] - x[3], y[2] - y[3]
    whole = F.nullif(ax * by - bx * ay, F.lit(0.0))
    g, h = (sx * by - bx * sy) / whole, (ax * sy - sx * ay) / whole
    below = F.nullif(g * u + h * v + 1, F.lit(0.0))
    return ((x[1] - x[0] + g * x[1]) * u + (x[2] - x[0] + h * x[2]) * v + x[0]) / below, ((y[1] - y[0] + g * y[1]) * u + (y[2] - y[0] + h * y[2]) * v + y[0]) / below


def squares(codes: DataFrame) -> DataFrame:
    """(image, code, side, row, column, y, x): the pixel of each square of each code."""
    number = lambda c: F.col(c).cast("double")
    xs, ys = [number(f"x{i}") for i in range(3)], [number(f"y{i}") for i in range(3)]
    known = F.col("x3").isNotNull() & F.col("y3").isNotNull()
    xs.append(F.when(known, number("x3")).otherwise(xs[1] + xs[2] - xs[0]))
    ys.append(F.when(known, number("y3")).otherwise(ys[1] + ys[2] - ys[0]))
    placed = codes.select("image", "code", "side", *[c.alias(f"_x{i}") for i, c in enumerate(xs)], *[c.alias(f"_y{i}") for i, c in enumerate(ys)])
    line = F.sequence(F.lit(0), F.col("side") - 1)
    cells = placed.withColumn("row", F.explode(F.when(F.col("side") > 0, line))).withColumn("column", F.explode(line))
    unit = lambda c: (F.col(c) + 0.5 - MIDDLE) / (F.col("side") - 2 * MIDDLE)
    x, y = projective([F.col(f"_x{i}") for i in range(4)], [F.col(f"_y{i}") for i in range(4)], unit("column"), unit("row"))
    return cells.select("image", "code", "side", "row", "column", F.floor(y).alias("y"), F.floor(x).alias("x"))


def sampled(codes: DataFrame, pixels: DataFrame, value: Column) -> DataFrame:
    """(image, code, side, squares): for each code its squares row by row as text: 1 or 0 where `value` (a condition on the pixels
    (image, y, x, ...)) holds or not, ? where unknown. One join of as many rows as there are squares with the pixels, by their place."""
    p = pixels.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(value, "1").otherwise("0").alias("bit"))
    met = squares(codes).join(p, ["image", "y", "x"], "left")
    cell = F.struct(F.col("row"), F.col("column"), F.coalesce("bit", F.lit("?")).alias("bit"))
    listed = met.groupBy("image", "code", "side").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    return listed.select("image", "code", "side", F.array_join(F.transform("c", lambda c: c["bit"]), "").alias("squares"))
