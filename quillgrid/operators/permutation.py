"""Keyed permutations of small rasters: chaotic orders of rows and columns, and seeded blocks.

A permutation is an array `source`: place i of the scrambled raster gets what stood at source[i]; undoing it scatters
instead. The sequences behind them can't be cut, so one raster (a tile of bounded size) is one array value.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import WIDTH
from .raster import curve, shift

# The logistic factor, and the state that a seed of zero stands for.
FACTOR = 3.9999999
ZERO_STATE = 0x6D2B79F5


def chaotic_orders(key: float, length: int, lines: int, advance: bool) -> np.ndarray:
    """For each line the order of its logistic values, ties by place. With `advance` a line starts at the value the
    line before ended with: all lines are windows of one sequence that overlap in one value."""
    if length == 1:
        return np.zeros((lines, 1), dtype=np.int64)
    values = np.empty((lines if advance else 1) * (length - 1) + 1)
    x = key
    for i in range(len(values)):
        values[i] = x
        x = FACTOR * x * (1 - x)
    windows = np.lib.stride_tricks.sliding_window_view(values, length)[:: length - 1]
    return np.broadcast_to(np.argsort(windows, axis=1, kind="stable"), (lines, length))


@lru_cache(64)
def chaotic(width: int, height: int, key: float, columns: bool, advance: bool = True) -> np.ndarray:
    """Rows are put in chaotic order, then (with `columns`) columns."""
    source = np.arange(width * height).reshape(height, width)
    source = np.take_along_axis(source, chaotic_orders(key, width, height, columns or advance), axis=1)
    if columns:
        source = np.take_along_axis(source, chaotic_orders(key, height, width, True).T, axis=0)
    return source.ravel()


def draws(seed: str):  # noqa: ANN201
    """below -> a number under it, from a 32-bit xorshift generator, without modulo bias."""
    words = np.frombuffer(bytes.fromhex(seed), dtype=">u4")
    state = int(np.bitwise_xor.reduce(words)) or ZERO_STATE

    def draw(below: int) -> int:
        nonlocal state
        while True:
            for left, right in ((13, 0), (0, 17), (5, 0)):
                state ^= ((state << left) & 0xFFFFFFFF) if left else state >> right
            if state < 2**32 // below * below:
                return state % below

    return draw


@lru_cache(64)
def blocks(width: int, height: int, seed: str, block: int = 16) -> np.ndarray:
    """Blocks of equal shape change places; inside, pixels move along the block's curve, then flip and turn."""
    draw, shapes = draws(seed), {}
    for y in range(0, height, block):
        for x in range(0, width, block):
            shapes.setdefault((min(block, width - x), min(block, height - y)), []).append((x, y))
    source = np.empty(width * height, dtype=np.int64)
    for (w, h), corners in shapes.items():
        goes = list(range(len(corners)))
        for i in range(len(goes) - 1, 0, -1):
            j = draw(i + 1)
            goes[i], goes[j] = goes[j], goes[i]
        path = np.array(curve(w, h))
        ahead = np.roll(path, -shift(len(path), 1.0), axis=0)
        for (ax, ay), to in zip(corners, goes):
            turns, flip = draw(4 if w == h else 2), draw(2)
            x, y = ahead.T
            x = w - 1 - x if flip else x
            if w != h and turns:
                x, y = w - 1 - x, h - 1 - y
            for _ in range(turns if w == h else 0):
                x, y = w - 1 - y, x
            bx, by = corners[to]
            source[(by + y) * width + bx + x] = (ay + path[:, 1]) * width + ax + path[:, 0]
    return source


def permuted(pixels: DataFrame, height: int, permutation, back: bool = False, **how) -> DataFrame:  # noqa: ANN001
    """Tiles of WIDTH x height pixels, each permuted as one array of at most that many values."""

    @F.pandas_udf("array<int>")
    def move(values: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> np.ndarray:
            source = permutation(WIDTH, len(v) // WIDTH, **how)
            if not back:
                return v[source]
            out = np.empty_like(v)
            out[source] = v
            return out

        return values.map(lambda v: one(np.asarray(v)))

    tiles = pixels.groupBy(F.floor(F.col("y") / height).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v")))["v"].alias("v"))
    placed = tiles.select("tile", F.posexplode(move("v")).alias("i", "v"))
    return placed.select((F.col("tile") * height + F.floor(F.col("i") / WIDTH)).alias("y"), (F.col("i") % WIDTH).alias("x"), "v")
