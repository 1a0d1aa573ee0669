"""Operators on pixel relations (y, x, v): permutation, spatial windows, histograms, search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import WIDTH

#: Share of a raster that one unit of strength shifts by: the golden section.
SECTION = (math.sqrt(5) - 1) / 2
SAMPLE_PIXELS = 12_000
#: Rows of a tile that a window down a column holds.
TILE_ROWS = 512


def shift(n: int, strength: float) -> int:
    return math.floor(strength * SECTION * n + 0.5) % n if n else 0


def shifted(line: DataFrame, n: int, offset: int) -> DataFrame:
    """(i, v) moved along its line: place i gets what stood at (i + offset) mod n. A projection, no join."""
    return line.withColumn("i", F.pmod(F.col("i") - offset, F.lit(max(1, n))))


def curve(width: int, height: int) -> list[tuple[int, int]]:
    """A continuous path through every cell of a rectangle (the generalised Hilbert curve), with a stack of pieces.

    A piece is a corner, its main direction and its side direction; a long one is cut in two, any other in three, at
    even lengths where possible.
    """
    half = lambda v: (v[0] // 2, v[1] // 2)
    unit = lambda v: tuple((c > 0) - (c < 0) for c in v)
    span = lambda v: abs(sum(v))
    add = lambda *vs: (sum(v[0] for v in vs), sum(v[1] for v in vs))
    neg = lambda v: (-v[0], -v[1])
    cells: list[tuple[int, int]] = []
    todo = [((0, 0), (width, 0), (0, height)) if width >= height else ((0, 0), (0, height), (width, 0))]
    while todo:
        at, main, side = todo.pop()
        dm, ds = unit(main), unit(side)
        if span(side) == 1 or span(main) == 1:
            step, n = (dm, span(main)) if span(side) == 1 else (ds, span(side))
            cells += [(at[0] + k * step[0], at[1] + k * step[1]) for k in range(n)]
            continue
        m2, s2 = half(main), half(side)
        if 2 * span(main) > 3 * span(side):
            if span(m2) % 2 and span(main) > 2:
                m2 = add(m2, dm)
            pieces = [(at, m2, side), (add(at, m2), add(main, neg(m2)), side)]
        else:
            if span(s2) % 2 and span(side) > 2:
                s2 = add(s2, ds)
            pieces = [
                (at, s2, m2),
                (add(at, s2), main, add(side, neg(s2))),
                (add(at, main, neg(dm), s2, neg(ds)), neg(s2), neg(add(main, neg(m2)))),
            ]
        todo += reversed(pieces)
    return cells


def curve_table(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(p, x, y) along the curve of one tile (at most a few thousand cells)."""
    return spark.createDataFrame([(p, x, y) for p, (x, y) in enumerate(curve(width, height))], "p int, x int, ty int")


def scramble(pixels: DataFrame, height: int, rows: int, strength: float = 1.0, back: bool = False) -> DataFrame:
    """Shift each tile of WIDTH x height pixels along its own curve; `back` undoes it. rows: the raster's height."""
    spark = pixels.sparkSession
    tiles = pixels.withColumn("tile", F.floor(F.col("y") / height).cast("long")).withColumn("ty", (F.col("y") % height).cast("int"))
    out = None
    for h, which in ((height, F.col("tile") < rows // height), (rows % height, F.col("tile") == rows // height)):
        if not h:
            continue
        n = WIDTH * h
        path = F.broadcast(curve_table(spark, WIDTH, h))
        k = shift(n, strength) * (-1 if back else 1)
        moved = tiles.where(which).join(path, ["x", "ty"]).select("tile", F.pmod(F.col("p") - k, F.lit(n)).cast("int").alias("p"), "v").join(path, "p")
        part = moved.select((F.col("tile") * height + F.col("ty")).alias("y"), "x", "v")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pixels.select("y", "x", "v")


def tiled(pixels: DataFrame, radius: int, rows: int = TILE_ROWS) -> DataFrame:
    """pixels with `tile`, each row also in the tile above or below that looks at most `radius` rows over its edge: a window
    down a column then holds a tile's rows, not the table's. `own` keeps what belongs to its tile."""
    at = lambda y: F.floor(y / rows)
    near = F.array_distinct(F.array(at(F.col("y")), at(F.col("y") - radius), at(F.col("y") + radius)))
    return pixels.withColumn("tile", F.explode(near))


def own(pixels: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    return pixels.where(F.floor(F.col("y") / rows) == F.col("tile")).drop("tile")


def down() -> WindowSpec:
    """A column of a tile from top to bottom."""
    return Window.partitionBy("tile", "x").orderBy("y")


def box_mean(pixels: DataFrame, radius: int, along: str, across: str) -> DataFrame:
    """Mean of the 2 * radius + 1 values along an axis, clipped at the edges and truncated."""
    columns = pixels.columns
    w = (down() if along == "y" else Window.partitionBy(across).orderBy(along)).rowsBetween(-radius, radius)
    mean = F.floor(F.sum("v").over(w) / F.count("v").over(w)).cast("int")
    return own(tiled(pixels, radius).withColumn("v", mean)).select(*columns) if along == "y" else pixels.withColumn("v", mean)


def running_down(pixels: DataFrame, name: str, rows: int = TILE_ROWS) -> DataFrame:
    """`name` summed from the top of each column to each row: within tiles, plus the sums of the tiles above, of which there
    are as many as the table has tiles."""
    tiles = pixels.withColumn("tile", F.floor(F.col("y") / rows))
    above = Window.partitionBy("x").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    sums = tiles.groupBy("x", "tile").agg(F.sum(name).alias("_sum")).select("x", "tile", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    return tiles.join(sums, ["x", "tile"]).withColumn(name, F.sum(name).over(down()) + F.col("_above")).drop("tile", "_above")


def quantile(histogram: DataFrame, per_mille: Column) -> Column:
    """As an aggregate over (bin, below, total): the first bin whose running count reaches its rank."""
    need = F.greatest(F.lit(1), F.floor((F.col("total") * per_mille + 999) / 1000))
    return F.min(F.when(F.col("upto") >= need, F.col("bin")))


def running(histogram: DataFrame) -> DataFrame:
    """(bin, n) with upto and total; a histogram has few bins."""
    return histogram.withColumn("upto", F.sum("n").over(Window.orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy()))


def predictor_costs(pixels: DataFrame) -> DataFrame:
    """(y, filter, cost): the sum of absolute residuals of each row under the five PNG predictors."""
    left = Window.partitionBy("y").orderBy("x")
    p = own(tiled(pixels, 1).withColumn("b", F.coalesce(F.lag("v").over(down()), F.lit(0)))).withColumn("a", F.coalesce(F.lag("v").over(left), F.lit(0))).withColumn("c", F.coalesce(F.lag("b").over(left), F.lit(0)))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    nearest = F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)
    residuals = [F.lit(0), a, b, F.floor((a + b) / 2).cast("int"), nearest]
    costs = [F.pmod(F.col("v") - r, F.lit(256)) for r in residuals]
    sums = p.groupBy("y").agg(*[F.sum(F.least(r, 256 - r)).alias(str(k)) for k, r in enumerate(costs)])
    return sums.select("y", F.posexplode(F.array(*[F.col(str(k)) for k in range(5)])).alias("filter", "cost"))


def scored_shifts(pixels: DataFrame, rows: int, offsets: DataFrame, tried: list[int]) -> DataFrame:
    """offsets (offset and others, a few hundred rows; `tried` are theirs) with score: the mean difference of
    neighbours on a sampled grid after a shift along the line by the offset is undone."""
    n = WIDTH * rows
    stride = max(1, math.isqrt(n // SAMPLE_PIXELS))
    line = pixels.select((F.col("y") * WIDTH + F.col("x")).alias("i"), "v")
    following = lambda k, name: line.select(F.pmod(F.col("i") - k, F.lit(n)).alias("i"), F.col("v").alias(name))
    steps = line.join(following(1, "right"), "i").join(following(WIDTH, "down"), "i").select(F.col("i").alias("j"), F.abs(F.col("v") - F.col("right")).alias("dr"), F.abs(F.col("v") - F.col("down")).alias("dd"))
    grid = pixels.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0)).select((F.col("y") * WIDTH + F.col("x")).alias("i"), (F.col("x") < WIDTH - 1).cast("int").alias("r"), (F.col("y") < rows - 1).cast("int").alias("d"))
    # at most 4 * SAMPLE_PIXELS samples, whatever the raster, for each offset
    probes = grid.withColumn("offset", F.explode(F.array(*[F.lit(o).cast("long") for o in sorted(set(tried))]))).withColumn("j", F.pmod(F.col("i") + F.col("offset"), F.lit(n)))
    # neither side is small, though an exploded one is estimated to be
    sums = probes.hint("merge").join(steps, "j").groupBy("offset").agg(F.sum(F.col("dr") * F.col("r") + F.col("dd") * F.col("d")).alias("total"), F.sum(F.col("r") + F.col("d")).alias("n"))
    return sums.join(F.broadcast(offsets), "offset").withColumn("score", F.round(F.col("total") / F.col("n"), 6))


def rank_shifts(pixels: DataFrame, rows: int, preferred: int = 10, rounds_first: int = 1, top: int = 3) -> DataFrame:
    """The best (strength, rounds) for undoing a shift along the line: every distinct offset is scored once; ties by
    distance from the preferred strength, then rounds."""
    n = WIDTH * rows
    strengths = [preferred, *[s for s in range(21) if s != preferred]]
    tried = [rounds_first, *[r for r in range(1, 21) if r != rounds_first]]
    seen: dict[int, tuple[int, int]] = {}
    for s in strengths:
        for r in tried:
            seen.setdefault(shift(n, s / 10) * r % max(1, n), (s, r))
    offsets = pixels.sparkSession.createDataFrame([(o, s, r) for o, (s, r) in seen.items()], "offset long, strength int, rounds int")  # at most 420 rows
    ranked = scored_shifts(pixels, rows, offsets, list(seen))
    return ranked.orderBy("score", F.abs(F.col("strength") - preferred), (F.col("rounds") != rounds_first).cast("int"), "rounds", "strength").limit(top).select("strength", "rounds", "offset", "score")


def rank_rounds(pixels: DataFrame, rows: int, strength: float = 1.0) -> DataFrame:
    """1 to 20 rounds of one strength by score, then rounds."""
    n = WIDTH * rows
    tried = [shift(n, strength) * r % max(1, n) for r in range(1, 21)]
    offsets = pixels.sparkSession.createDataFrame(list(zip(tried, range(1, 21))), "offset long, rounds int")
    return scored_shifts(pixels, rows, offsets, tried).orderBy("score", "rounds").select("rounds", "offset", "score")


def green_adjusted(red: Column, green: Column, blue: Column, enhance: bool) -> list[Column]:
    """Red, green and blue (0-255) with greens (hue 75 to 165 degrees, neither gray nor near black or white) made
    stronger or weaker in HSL terms; other colours stay."""
    r, g, b = (c / F.lit(255.0) for c in (red, green, blue))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d, light = most - least, (most + least) / 2
    s = F.when(d == 0, 0.0).when(light > 0.5, d / (F.lit(2.0) - most - least)).otherwise(d / (most + least)) * 100
    hue = F.when(d == 0, 0.0).when(most == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6 * 360
    hit = hue.between(75, 165) & (s > 8) & (light * 100 > 10) & (light * 100 < 90)
    if enhance:
        strong = F.least(s, F.lit(70.0)) / 100
        fg, frb = 1 + strong * 0.6, F.greatest(F.lit(0.7), 1 - strong * 0.3)
    else:
        strong = F.least(s, F.lit(80.0)) / 100
        fg, frb = F.greatest(F.lit(0.5), 1 - strong * 0.5), F.least(F.lit(1.3), 1 + strong * 0.3)
    return [F.when(hit, F.least(F.lit(255), F.floor(c * f + 0.5))).otherwise(c).cast("int") for c, f in ((red, frb), (green, fg), (blue, frb))]


def components(mask: DataFrame, most: int = 500) -> DataFrame:
    """(y, x, label) of the 4-connected parts of a mask: least place number, spread and jumped until it settles."""
    cells = mask.select("y", "x", (F.col("y") * WIDTH + F.col("x")).alias("i"))
    state = cells.withColumn("label", F.col("i")).checkpoint()
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    for _ in range(most):
        sent = state.withColumn("s", F.explode(steps)).select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label")
        near = sent.groupBy("y", "x").agg(F.min("label").alias("near"))
        spread = state.join(near, ["y", "x"])
        jump = state.select(F.col("i").alias("near"), F.col("label").alias("further"))
        after = spread.join(jump, "near").select("y", "x", "i", F.col("label").alias("old"), F.least("near", "further").alias("label")).checkpoint()
        state = after.drop("old")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return state.select("y", "x", "label")
    raise RuntimeError("components did not settle")


@dataclass(frozen=True)
class Search:
    """What is tried: a preferred strength first, then 0.0 to 2.0 by tenths, each with the preferred rounds first, then 1 to 20."""

    strength: float = 1.0
    rounds: int = 1

    def offsets(self, n: int) -> list[tuple[int, float, int]]:
        """(offset, strength, rounds): of those that shift alike the first one tried."""
        strengths = list(dict.fromkeys([self.strength, *[s / 10 for s in range(21)]]))
        seen: dict[int, tuple[float, int]] = {}
        for s in strengths:
            for r in dict.fromkeys([self.rounds, *range(1, 21)]):
                seen.setdefault(shift(n, s) * r % n, (s, r))
        return [(o, *x) for o, x in seen.items()]


@dataclass(frozen=True)
class Given(Search):
    """Offsets that are given: (offset, strength, rounds)."""

    tried: tuple[tuple[int, float, int], ...] = ()

    def offsets(self, n: int) -> list[tuple[int, float, int]]:
        return list(self.tried)


def rank_along_curve(pictures: DataFrame, height: int, search: Search = Search(), top: int = 3) -> DataFrame:
    """(image, rank, strength, rounds, offset, score): the best ways to undo a shift of each picture of WIDTH x height pixels
    along its curve, by the mean difference of neighbours on a sampled grid; ties by distance from the preferred strength,
    then the preferred rounds, fewer rounds, less strength. A picture is one row of bounded size."""
    path = np.array(curve(WIDTH, height))
    place = np.empty((height, WIDTH), dtype=np.int64)
    place[path[:, 1], path[:, 0]] = np.arange(len(path))
    n = WIDTH * height
    stride = max(1, math.isqrt(n // SAMPLE_PIXELS))
    ys, xs = np.mgrid[0:height:stride, 0:WIDTH:stride]
    pairs = [(place[y, x], place[y + dy, x + dx]) for dy, dx in ((0, 1), (1, 0)) for y, x in [(ys[(ys + dy < height) & (xs + dx < WIDTH)], xs[(ys + dy < height) & (xs + dx < WIDTH)])]]
    one, other = (np.concatenate(side) for side in zip(*pairs))
    tried = search.offsets(n)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = np.empty(n, dtype=np.int64)
                line[place.ravel()] = values.values.to_numpy()
                scores = [round(float(np.abs(line[(one + o) % n] - line[(other + o) % n]).mean()), 6) for o, _, _ in tried]
                order = sorted(range(len(tried)), key=lambda i: (scores[i], round(abs(tried[i][1] - search.strength), 6), tried[i][2] != search.rounds, tried[i][2], tried[i][1]))[:top]
                columns = [[image] * len(order), list(range(1, len(order) + 1)), [tried[i][1] for i in order], [tried[i][2] for i in order], [tried[i][0] for i in order], [scores[i] for i in order]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.float64()))], names=["image", "rank", "strength", "rounds", "offset", "score"])

    rows = pictures.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p")).where(F.size("p") == n)
    return rows.select("image", F.transform("p", lambda c: c["v"]).alias("v")).mapInArrow(ranked, "image long, rank int, strength double, rounds int, offset long, score double")
