"""Smoothing and resizing of pictures that are rows of arrays (image, y, v): weights are whole numbers of 1/65536.

Along a row a value is an expression over its array; down a column it is one over the rows that a window or a join brings
together. No pixel is exploded, and a row is sent to as many places as it is looked at from beyond its tile, or as results
take it in.

Cases: a picture without rows has none; nulls in an array count as 0; rows of one picture have one length, each y once; results
are rounded half up; edges repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE = 1 << 16
TILE_ROWS = 512


def whole(weights: list[float]) -> list[int]:
    """Weights as whole numbers that add up to ONE; what rounding leaves goes to the largest."""
    out = [math.floor(w / sum(weights) * ONE + 0.5) for w in weights]
    out[max(range(len(out)), key=lambda i: (weights[i], -i))] += ONE - sum(out)
    return out


def gaussian(sigma: float) -> list[int]:
    """The kernel of 2 * ceil(3 * sigma) + 1 weights."""
    r = math.ceil(3 * sigma)
    return whole([math.exp(-(i**2) / (2 * sigma**2)) for i in range(-r, r + 1)])


def _rounded(total: Column) -> Column:
    return F.shiftright(total + ONE // 2, 16).cast("int")


def smoothed(rows: DataFrame, kernel: list[int]) -> DataFrame:
    """(image, y, v): rows with a symmetric kernel along both axes, first along the rows."""
    r = len(kernel) // 2
    v = F.col("v")
    last = F.size(v) - 1

    def at(i: Column, k: int) -> Column:
        return F.coalesce(F.get(v, F.greatest(F.lit(0), F.least(last, i + k))), F.lit(0)).cast("long")

    def along(i: Column) -> Column:
        total = at(i, 0) * kernel[r]
        for k in range(1, r + 1):
            total = total + (at(i, -k) + at(i, k)) * kernel[r + k]
        return _rounded(total)

    across = rows.select("image", "y", F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), along)).otherwise(F.array().cast("array<int>")).alias("v"))
    tile = lambda y: F.floor(y / TILE_ROWS)
    near = F.array_distinct(F.array(tile(F.col("y")), tile(F.col("y") - r), tile(F.col("y") + r)))
    tiles = across.withColumn("tile", F.explode(near))
    w = Window.partitionBy("image", "tile").orderBy("y")
    # beyond the first and last row of a picture the edge is repeated: the nearest row there is
    named = {0: "v"} | {k: f"_{k + r}" for k in range(-r, r + 1) if k}
    held = tiles.withColumns({named[k]: F.lag("v", -k).over(w) if k < 0 else F.lead("v", k).over(w) for k in named if k})
    for step in (1, -1):
        for k in range(step, step * (r + 1), step):
            held = held.withColumn(named[k], F.coalesce(named[k], named[k - step]))
    own = held.where(tile(F.col("y")) == F.col("tile"))

    def down(i: Column) -> Column:
        total = F.get("v", i).cast("long") * kernel[r]
        for k in range(1, r + 1):
            total = total + (F.get(named[-k], i) + F.get(named[k], i)).cast("long") * kernel[r + k]
        return _rounded(total)

    return own.select("image", "y", F.when(F.size("v") > 0, F.transform(F.sequence(F.lit(0), F.size("v") - 1), down)).otherwise(F.col("v")).alias("v"))


def area(old: int, new: int) -> list[tuple[int, int, int]]:
    """(result, source, weight): each result is the mean of what it covers."""
    return _weights(old, new, lambda low, high, i: max(0.0, min(high, i + 1) - max(low, i)))


def bilinear(old: int, new: int) -> list[tuple[int, int, int]]:
    """(result, source, weight): a triangle around each result's middle, as wide as the step between results, or sources."""
    reach = max(1.0, old / new)
    return _weights(old, new, lambda low, high, i: max(0.0, 1 - abs((i + 0.5) - (low + high) / 2) / reach), reach)


def _weights(old: int, new: int, weight: Callable[[float, float, int], float], reach: float = 0.0) -> list[tuple[int, int, int]]:
    out = []
    for o in range(new):
        low, high = o * old / new, (o + 1) * old / new
        middle = (low + high) / 2
        first, last = max(0, math.floor(min(low, middle - reach))), min(old - 1, math.ceil(max(high, middle + reach)))
        some = [(i, w) for i in range(first, last + 1) if (w := weight(low, high, i)) > 1e-9]
        out += [(o, i, w) for (i, _), w in zip(some, whole([w for _, w in some])) if w]
    return out


def resized(rows: DataFrame, width: int, new_width: int, targets: DataFrame, weights: Callable[[int, int], list[tuple[int, int, int]]]) -> DataFrame:
    """(image, y, v): pictures of `width` and any heights, at new_width and the height that `targets` (image, m) has for each.

    The weights down the columns are a small table by both heights (of which there are as many as picture formats); rows meet it,
    and a result gathers the few rows it takes in.
    """
    spark = rows.sparkSession
    taps = [[(i, w) for p, i, w in weights(width, new_width) if p == o] for o in range(new_width)]
    literal = F.array(*[F.struct(F.lit(t[0][0]).alias("first"), F.array(*[F.lit(w).cast("long") for _, w in t]).alias("w")) for t in taps])
    value = lambda t: F.aggregate(F.transform(t["w"], lambda w, k: w * F.coalesce(F.get("v", t["first"] + k), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    narrow = rows.select("image", "y", F.transform(literal, lambda t: _rounded(value(t))).alias("v"))
    heights = rows.groupBy("image").agg((F.max("y") + 1).alias("h")).join(targets.select("image", F.col("m").cast("int").alias("m")), "image")
    formats = [(r["h"], r["m"]) for r in heights.select("h", "m").distinct().collect()]
    down = [(h, m, *t) for h, m in formats for t in weights(h, m)]
    table = F.broadcast(spark.createDataFrame(down, "h int, m int, _y int, y int, w long"))  # a few rows for each row of a format
    met = narrow.join(heights, "image").join(table, ["h", "m", "y"])
    met = met.groupBy("image", "_y").agg(F.sort_array(F.collect_list(F.struct("y", "w", "v"))).alias("rows"))
    nothing = F.array_repeat(F.lit(0).cast("long"), new_width)
    total = F.aggregate("rows", nothing, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b * x["w"]))
    return met.select("image", F.col("_y").alias("y"), F.transform(total, _rounded).alias("v"))


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """(image, total, most, pixels): how far two versions of pictures are apart."""
    b = other.select("image", "y", F.col("v").alias("b"))
    gaps = one.join(b, ["image", "y"]).select("image", F.zip_with("v", "b", lambda p, q: F.abs(p - q)).alias("d"))
    row = gaps.select("image", F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("d").alias("most"), F.size("d").alias("n"))
    return row.groupBy("image").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("n").alias("pixels"))


def _sized(rows: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    return rows.groupBy("image").agg(of(F.max("y") + 1).alias("m"))


def detail(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The finest detail of pictures, and what is left without it at half the size (rounded up): rows = detail + that enlarged."""
    half = resized(rows, width, -(-width // 2), _sized(rows, lambda h: F.ceil(h / 2)), bilinear)
    up = resized(half, -(-width // 2), width, _sized(rows, lambda h: h), bilinear).select("image", "y", F.col("v").alias("u"))
    return rows.join(up, ["image", "y"]).select("image", "y", F.zip_with("v", "u", lambda a, b: a - b).alias("v")), half


def pyramid(rows: DataFrame, width: int, levels: int) -> list[DataFrame]:
    """Pictures as details by scale, finest first, and last what is left: a list of rows, each at half the size of the one before."""
    out = []
    for _ in range(levels):
        fine, rows = detail(rows, width)
        out.append(fine)
        width = -(-width // 2)
    return [*out, rows]


def rebuilt(parts: list[DataFrame], width: int) -> DataFrame:
    """Pictures from the details of `pyramid`: exactly those they are of."""
    widths = [width]
    for _ in parts[1:]:
        widths.append(-(-widths[-1] // 2))
    rows = parts[-1]
    for part, fine, coarse in zip(parts[-2::-1], widths[-2::-1], widths[:0:-1]):
        up = resized(rows, coarse, fine, _sized(part, lambda h: h), bilinear).select("image", "y", F.col("v").alias("u"))
        rows = part.join(up, ["image", "y"]).select("image", "y", F.zip_with("v", "u", lambda a, b: a + b).alias("v"))
    return rows


def strengthened(shown: DataFrame, source: DataFrame, blurred: DataFrame, where: Callable[[Column, Column], Column], share: float = 0.5) -> DataFrame:
    """`shown` with `share` of the fine detail of `source` (its difference from `blurred`) where where(shown, source) holds; halves
    are rounded to even. All are rows of the same pictures."""
    other = lambda df, name: df.select("image", "y", F.col("v").alias(name))
    met = shown.join(other(source, "s"), ["image", "y"]).join(other(blurred, "b"), ["image", "y"])

    def value(x: Column, i: Column) -> Column:
        s, b = F.get("s", i), F.get("b", i)
        new = F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x + (s - b) * F.lit(share)))).cast("int")
        return F.when(where(x, s), new).otherwise(x)

    return met.select("image", "y", F.transform("v", value).alias("v"))
