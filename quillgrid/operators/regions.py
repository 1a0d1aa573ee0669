"""Images as (image, y, x, v) rows: local thresholds by blocks, growing and shrinking, boxes that suppress each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ordered import by_key

BLOCK, LEAST_SIDE, FLAT = 8, 40, 24
#: Boxes up to this power of two are of one class; rows of boxes that are worked on at a time, and pairs of them.
LEAST_CLASS, TILE_ROWS, PAIRS = 7, 100_000, 1_000_000
#: Rings of a block, some rings of a task, arms and comparisons that are held at a time; a sector is as wide as an arm may be off a right angle.
RINGS, CORNER_ROWS, ARMS, MET, SECTORS = 1024, 6_000, 20_000, 50_000, 52


def block_index(at: Column, size: Column) -> Column:
    """The blocks of 8 that hold a place: its own, and the last one, which is moved back to fit."""
    last = F.floor((size - 1) / BLOCK).cast("int")
    own = F.floor(at / BLOCK).cast("int")
    whole = F.when((own < last) | (size % BLOCK == 0), own)
    return F.array_compact(F.array(whole, F.when((at >= size - BLOCK) & (size % BLOCK != 0), last)))


def block_stats(pixels: DataFrame) -> DataFrame:
    """(image, gy, gx, low, high, mean) for images of 40 x 40 and more; the mean is cut to an integer."""
    sizes = pixels.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).where((F.col("h") >= LEAST_SIDE) & (F.col("w") >= LEAST_SIDE))
    p = pixels.join(sizes, "image")
    cells = p.withColumn("gy", F.explode(block_index(F.col("y"), F.col("h")))).withColumn("gx", F.explode(block_index(F.col("x"), F.col("w"))))
    return cells.groupBy("image", "gy", "gx").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.floor(F.sum("v") / 64).cast("int").alias("mean"))


def window_sums(blocks: DataFrame, *values: str) -> DataFrame:
    """(image, gy, gx, value...) summed over the 5 x 5 blocks around each, centres kept 2 off the edge.

    Each block is sent to those that count it, so no window has to hold an image.
    """
    whole = Window.partitionBy("image")
    sized = blocks.withColumns({"_h": F.max("gy").over(whole) + 1, "_w": F.max("gx").over(whole) + 1})

    def counted_by(at: str, size: str) -> Column:
        centre = lambda i: F.greatest(F.lit(2), F.least(F.col(size) - 3, i))
        near = F.sequence(F.greatest(F.lit(0), F.col(at) - 4), F.least(F.col(size) - 1, F.col(at) + 4))
        return F.explode(F.filter(near, lambda i: F.abs(centre(i) - F.col(at)) <= 2))

    sent = sized.select("image", counted_by("gy", "_h").alias("_y"), "gx", "_w", *values)
    sent = sent.groupBy("image", F.col("_y").alias("gy"), "gx", "_w").agg(*[F.sum(v).alias(v) for v in values])
    sent = sent.select("image", "gy", counted_by("gx", "_w").alias("_x"), *values)
    return sent.groupBy("image", "gy", F.col("_x").alias("gx")).agg(*[F.sum(v).alias(v) for v in values])


def contrast_thresholds(blocks: DataFrame) -> DataFrame:
    """(image, gy, gx, threshold): middle values of blocks with contrast, smoothed; blocks that have none in reach take
    the next one's, at the end the last one's."""
    middle = F.when(F.col("high") - F.col("low") > FLAT, F.floor((F.col("high") + F.col("low")) / 2)).otherwise(0).cast("int")
    own = blocks.select("image", "gy", "gx", middle.alias("m")).withColumn("n", (F.col("m") > 0).cast("int"))
    sums = window_sums(own, "m", "n").withColumnsRenamed({"m": "sm", "n": "sn"})
    count = F.col("n") * 2 + F.col("sn")
    smooth = own.join(sums, ["image", "gy", "gx"]).select("image", "gy", "gx", F.when(count > 0, F.floor((F.col("m") * 2 + F.col("sm")) / count)).alias("t"))
    valid = F.when(F.col("t") > 0, F.col("t"))
    line = Window.partitionBy("image").orderBy("gy", "gx")
    ahead, behind = line.rowsBetween(0, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.first(valid, ignorenulls=True).over(ahead), F.last(valid, ignorenulls=True).over(behind), F.lit(0))
    return smooth.select("image", "gy", "gx", filled.cast("int").alias("threshold"))


def corrected(blocks: DataFrame) -> DataFrame:
    """(image, gy, gx, point): the mean of each block, where it is flat half its least value or, right and below of others, what
    its corrected neighbours say if that is more.

    The rule goes from block to block. A picture's rows of blocks (1/64 of its pixels) are folded from top to bottom, each along
    the corrected row above; both folds are array expressions. Cases: a picture lacks no block; one block is a picture.
    """
    cell = F.struct("gx", "low", "high", "mean")
    lines = blocks.groupBy("image", "gy").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    pictures = lines.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("gy", "cells"))).alias("lines"))
    number = lambda x: x.cast("int")

    def point(s: Column, c: Column, above: Column) -> Column:
        """s: what is known of the line so far; above: the corrected line above, empty at the top."""
        i = F.size(s)
        near = number(F.floor((F.get(above, i) + 2 * F.get(s, i - 1) + F.get(above, i - 1)) / 4))
        inner = (i > 0) & (F.size(above) > 0)
        flat = F.when(inner & (c["low"] < near), near).otherwise(number(F.floor(c["low"] / 2)))
        return F.when(c["high"] - c["low"] > FLAT, number(c["mean"])).otherwise(flat)

    none = F.array().cast("array<int>")
    line = lambda above, cells: F.aggregate(cells, none, lambda s, c: F.array_append(s, point(s, c, above)))
    start = F.array().cast("array<array<int>>")
    told = F.aggregate("lines", start, lambda s, x: F.array_append(s, line(F.coalesce(F.get(s, F.size(s) - 1), none), x["cells"])))
    rows = pictures.select("image", F.posexplode(told).alias("gy", "points"))
    return rows.select("image", "gy", F.posexplode("points").alias("gx", "point"))


def mean_thresholds(blocks: DataFrame) -> DataFrame:
    """(image, gy, gx, threshold): corrected means, averaged over 5 x 5 blocks."""
    return window_sums(corrected(blocks), "point").select("image", "gy", "gx", F.floor(F.col("point") / 25).cast("int").alias("threshold"))


def neighbourhood(pixels: DataFrame, radius: int, grow: bool) -> DataFrame:
    """(image, y, x, v): the largest (grow) or least value within `radius` along both axes."""
    pick = F.max if grow else F.min
    along = lambda a, b: Window.partitionBy("image", a).orderBy(b).rowsBetween(-radius, radius)
    rows = pixels.withColumn("v", pick("v").over(along("y", "x")))
    return rows.withColumn("v", pick("v").over(along("x", "y")))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared area of two boxes (left, top, right, bottom) over their joint area."""
    wide, high = np.maximum(0, np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return wide * high / max(1, area(a) + area(b) - wide * high)


def suppressed(boxes: DataFrame, key: str, threshold: float = 0.45) -> DataFrame:
    """The boxes (`key`, box_id, score, left, top, right, bottom) that no better box of their key kept before overlaps too much.

    Order matters, so each key is walked from its best box down; only kept boxes are held.
    """

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for part in parts:
            hits = []
            for i, (k, box) in enumerate(zip(part[key], part[["left", "top", "right", "bottom"]].to_numpy(float))):
                if k != now:
                    now, kept = k, []
                if all(overlap(box, other) <= threshold for other in kept):
                    kept.append(box)
                    hits.append(i)
            yield part.iloc[hits]

    sorted_boxes = boxes.repartition(key).sortWithinPartitions(key, F.desc("score"), "box_id")
    return sorted_boxes.mapInPandas(walk, boxes.schema)


def _right_angles(rings: tuple[np.ndarray, ...], corner: slice, one: slice, other: slice) -> Iterator[tuple[np.ndarray, ...]]:
    """(corner, one, other, modules) of rings (x, y, d, in the order of their numbers) at these slices that fit, by their places.

    Arms are put in order of corner, sector and length, so one is compared with those whose length is near in the three sectors
    about a right angle on from its own. Some ARMS of them and MET comparisons are held at a time.
    """
    x, y, d = rings
    sized = d.min() > 0

    def arms(at: slice, to: slice) -> tuple[np.ndarray, ...]:
        """(corner, end, x, y, length, sector and its key, sort key), by the last."""
        c, e = np.divmod(np.arange((at.stop - at.start) * (to.stop - to.start), dtype=np.int32), np.int32(max(1, to.stop - to.start)))
        c, e = c + np.int32(at.start), e + np.int32(to.start)
        u, v = x[e] - x[c], y[e] - y[c]
        size = np.sqrt(u * u + v * v)
        may = (size > 0) & np.isfinite(size)
        if sized:  # two rings alike, and the third is no less than the larger of them over 1.25
            large = np.maximum(d[c], d[e])
            may &= (large / np.minimum(d[c], d[e]) <= 1.25) & (size >= 0.599999 * (d[c] + d[e] + large / 1.25))
        c, e, u, v, size = (g[may] for g in (c, e, u, v, size))
        sector = np.minimum(((np.arctan2(v, u) / (2 * np.pi)) % 1 * SECTORS).astype(np.int64), SECTORS - 1)
        length = np.log(size)
        key = ((c - at.start) * SECTORS + sector) * 2048.0 + length
        order = np.argsort(key)
        return tuple(g[order] for g in (c, e, u, v, size, sector, length, key))

    step = max(1, ARMS // max(one.stop - one.start, other.stop - other.start, 1))
    for start in range(corner.start, corner.stop, step):
        at = slice(start, min(start + step, corner.stop))
        c, e, u, v, size, sector, length, key = arms(at, one)
        _, e2, u2, v2, size2, *_, key2 = (c, e, u, v, size, key) if one == other else arms(at, other)
        for turn in (-1, 0, 1):
            there = ((c - at.start) * SECTORS + (sector + SECTORS // 4 + turn) % SECTORS) * 2048.0 + length
            low, high = np.searchsorted(key2, there - 0.166, "left"), np.searchsorted(key2, there + 0.166, "right")
            many = high - low
            upto, begin = np.cumsum(many), 0
            while begin < len(c):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - many[begin] + MET, "right")))
                i = np.repeat(np.arange(begin, end), many[begin:end])
                j = np.arange(len(i)) + np.repeat(low[begin:end] - (upto[begin:end] - many[begin:end]) + upto[begin] - many[begin], many[begin:end])
                begin = end
                size_i, size_j, dot = size[i], size2[j], np.abs(u[i] * u2[j] + v[i] * v2[j])
                upright = np.flatnonzero(dot <= 0.1200001 * size_i * size_j)
                i, j, dot, size_i, size_j = i[upright], j[upright], dot[upright], size_i[upright], size_j[upright]
                p, q, r = c[i], e[i], e2[j]
                # the two arms are taken in the order of their numbers, from the corner's on and around
                after = (q < r) ^ (q < p) ^ (r < p)
                lu, lv = np.where(after, size_i, size_j), np.where(after, size_j, size_i)
                first, second, third = d[p], d[np.where(after, q, r)], d[np.where(after, r, q)]
                mean, ratio = (first + second + third) / 3.0, lu / lv
                uneven = np.maximum(np.maximum(first, second), third) / np.minimum(np.minimum(first, second), third)
                fits = np.flatnonzero((np.minimum(lu, lv) >= 1.8 * mean) & (dot <= 0.12 * lu * lv) & (ratio >= 0.85) & (ratio <= 1.18) & (uneven <= 1.25))
                if len(fits):
                    lu, lv, mean = lu[fits], lv[fits], mean[fits]
                    yield p[fits], q[fits], r[fits], (np.rint(((lu + lv) / 2 / (mean / 7) + 7 - 21) / 4) * 4 + 21).astype(np.int32)


def corners(rings: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, corner, one, other, modules): rings (`key`, id, x, y, d) that can be a code's corner with two others: alike in
    size, arms alike in length and at a right angle, far enough apart. `one` to `other` turns clockwise on screen.

    All rings of a key take part, or its `most` widest if that is given. They are put in blocks of RINGS by their size, and any three
    blocks of a key meet once, so a task holds three at a time, whatever a key has. Rings with a null take no part.
    """
    widest = Window.partitionBy(key).orderBy(F.desc("d"), "id", "x", "y")
    r = rings.where(F.col(key).isNotNull()).select(key, "id", *[F.col(c).cast("double").alias(c) for c in "xyd"])
    r = r.withColumn("_n", F.row_number().over(widest).cast("long"))
    if most is not None:
        r = r.where(F.col("_n") <= most)
    r = r.withColumn("_last", F.floor((F.max("_n").over(Window.partitionBy(key)) - 1) / RINGS)).dropna(subset=["x", "y", "d"])
    sent = r.withColumn("_p", F.explode(F.expr("sequence(0L, _last)"))).withColumn("_q", F.explode(F.expr("sequence(_p, _last)")))
    sent = sent.withColumn("_met", F.array_sort(F.array(F.floor((F.col("_n") - 1) / RINGS), "_p", "_q")))
    blocks = ["_low", "_mid", "_high"]
    sent = sent.select(key, *[F.col("_met")[i].alias(c) for i, c in enumerate(blocks)], "_n", "id", "x", "y", "d")
    schema = T.StructType([T.StructField(key, rings.schema[key].dataType), *[T.StructField(c, rings.schema["id"].dataType) for c in ("corner", "one", "other")], T.StructField("modules", T.IntegerType())])

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The corners of three blocks, which may be one and the same: each block in turn as corner, one and other."""
        values = tuple(rows[c].to_numpy() for c in "xyd")
        block, names = (rows["_n"].to_numpy() - 1) // RINGS, rows["id"].combine_chunks()
        three = [rows[c][0].as_py() for c in blocks]
        at = {b: slice(*np.searchsorted(block, (b, b + 1)).tolist()) for b in three}
        with np.errstate(all="ignore"):
            for p, q, s in sorted(set(permutations(three))):
                for *found, modules in _right_angles(values, at[p], at[q], at[s]):
                    ids = [names.take(pa.array(f)) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.repeat(rows[key][0], len(modules)), *ids, pa.array(modules)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held else rows
            starts = np.flatnonzero(_changes(rows, [key, *blocks])).tolist()
            for a, b in zip(starts, starts[1:]):
                yield from met(rows.slice(a, b - a))
            held = rows.slice(starts[-1])
        if held:
            yield from met(held)

    dealt = by_key(sent, sent, key, *blocks, rows=CORNER_ROWS).sortWithinPartitions(key, *blocks, "_n")
    return dealt.mapInArrow(run, schema)


def _alike(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, copies: np.ndarray, tile: np.ndarray, own: np.ndarray, differ: int, reach: float) -> np.ndarray:
    """For each box at `own`: how many of its tile (numbers from 0, ascending) are alike and near. Boxes are put in order of tile,
    strip and left edge, so a box is compared with those of three strips whose left edges are near."""
    band = int(np.ceil(h[own].max() * reach))
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    x = x - np.minimum.reduceat(x, starts)[tile]
    strip = (y - np.minimum.reduceat(y, starts)[tile]) // band + 1
    line, width = tile * (strip.max() + 2) + strip, int(x.max()) + 1
    lines, rank = np.unique(line, return_inverse=True)
    order = np.argsort(rank * width + x, kind="stable")
    places, sx, sy, sw, sh, sn = (a[order] for a in (rank * width + x, x, y, w, h, copies))
    far, near = np.ceil(w[own] * reach).astype(np.int64), np.zeros(len(own), np.int64)
    for d in (-1, 0, 1):
        at = np.searchsorted(lines, line[own] + d)
        there = lines[np.minimum(at, len(lines) - 1)] == line[own] + d
        low = np.searchsorted(places, at * width + np.maximum(0, x[own] - far), "left")
        high = np.searchsorted(places, at * width + np.minimum(width - 1, x[own] + far), "right")
        many = np.where(there, high - low, 0)
        upto = np.cumsum(many)
        begin = 0
        while begin < len(own):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - many[begin] + PAIRS, "right")))
            i = np.repeat(np.arange(begin, end), many[begin:end])
            j = np.arange(len(i)) + np.repeat(low[begin:end] - (upto[begin:end] - many[begin:end]) + upto[begin] - many[begin], many[begin:end])
            o = own[i]
            met = (np.abs(w[o] - sw[j]) <= differ) & (np.abs(h[o] - sh[j]) <= differ) & (np.abs(sx[j] - x[o]) < w[o] * reach) & (np.abs(sy[j] - y[o]) < h[o] * reach)
            near[begin:end] += np.bincount(i[met] - begin, sn[j[met]], end - begin).astype(np.int64)
            begin = end
    return near


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in these columns; the first one does."""
    new = np.zeros(rows.num_rows, bool)
    for c in columns:
        v = rows[c].combine_chunks()
        new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    new[:1] = True
    return new


def alike_nearby(boxes: DataFrame, key: str, least: int = 8, differ: int = 2, reach: float = 3.6) -> DataFrame:
    """boxes (`key`, left, top, wide, high) with near: how many of the key, itself among them, are as wide and high but for `differ`
    and stand less than `reach` times its size away along both axes; those with at least `least`.

    A box is dealt to the tile it is in, and to those next to it that hold boxes it may be near to; a tile is 16 times as wide as
    the largest box of its class, so that most boxes are dealt once. Classes hold boxes of up to 128, and then up to twice the size of
    those before; a box is dealt to two where it can be alike to boxes of both. Copies are counted as one row. A task holds some
    TILE_ROWS rows or the different boxes of one tile, and compares those of near places. Boxes without a size, or a null, are left out.
    """
    names = ["left", "top", "wide", "high"]
    b = boxes.select(key, *[F.col(c).cast("int").alias(c) for c in names]).dropna().where("wide > 0 AND high > 0")
    class_of = lambda size: F.greatest(F.lit(LEAST_CLASS), F.ceil(F.log2(size))).cast("int")
    side = F.expr("shiftleft(16L, _c)")
    tile = lambda at: F.floor((at + side / 2) / side).cast("long")
    far = lambda size: F.ceil((F.col(size).cast("long") + differ) * reach)
    touched = lambda at, size: F.explode(F.sequence(tile(F.col(at).cast("long") - far(size)), tile(F.col(at).cast("long") + far(size))))
    larger = F.greatest("wide", "high").cast("long")
    sent = b.withColumn("_c", F.explode(F.sequence(class_of(F.greatest(F.lit(1).cast("long"), larger - differ)), class_of(larger + differ))))
    sent = sent.withColumn("_x", touched("left", "wide")).withColumn("_y", touched("top", "high"))
    sent = sent.withColumn("_own", (F.col("_c") == class_of(larger)) & (F.col("_x") == tile(F.col("left").cast("long"))) & (F.col("_y") == tile(F.col("top").cast("long"))))
    place = [key, "_c", "_x", "_y"]

    def counted(rows: pa.Table) -> pa.RecordBatch | None:
        x, y, w, h, n = (rows[c].to_numpy().astype(np.int64) for c in (*names, "n"))
        own = np.flatnonzero(rows["_own"].to_numpy())
        if not len(own):
            return None
        near = _alike(x, y, w, h, n, np.cumsum(_changes(rows, place)) - 1, own, differ, reach)
        found = rows.take(own[near >= least]).select([key, *names, "n"]).append_column("near", pa.array(near[near >= least]))
        return found.combine_chunks().to_batches()[0] if found.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            first = np.flatnonzero(_changes(rows, [*place, "_own", *names]))
            rows = rows.take(first).append_column("n", pa.array(np.diff(np.r_[first, batch.num_rows])))
            last = int(np.flatnonzero(_changes(rows, place))[-1])
            held, many = [*held, rows], many + rows.num_rows
            if many >= TILE_ROWS and last:
                whole = pa.concat_tables([*held[:-1], rows.slice(0, last)])
                held, many = [rows.slice(last)], rows.num_rows - last
                if (made := counted(whole)) is not None:
                    yield made
        if held and (made := counted(pa.concat_tables(held))) is not None:
            yield made

    dealt = by_key(sent, b, *place).sortWithinPartitions(*place, "_own", *names)
    kind = b.schema[key].dataType.simpleString()
    found = dealt.select(*place, "_own", *names).mapInArrow(run, f"`{key}` {kind}, left int, top int, wide int, high int, n long, near long")
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("_copy", "n")
