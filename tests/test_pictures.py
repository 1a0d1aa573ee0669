"""Places of codes, smoothing, resizing and block-to-block thresholds against plain NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import placement, regions, resample

CODE = placement.Code(side=20, finder=5, border=3, wanted=(0.4, 0.7))
RETRIES = placement.Retries(guarded=0.05, finder=0.01, unit=8, least_share=0.2, most=5)


def plain_best(guarded, ground, code):
    """The cheapest place by looking at every pixel of every candidate; None if the code does not fit."""
    h, w = guarded.shape
    side, b = code.side, code.border
    if min(h, w) < side + 2 * b:
        return None
    wanted = [max(b, min(n - side - b, max(0, min(n - side, round(n * s - side / 2))))) for n, s in ((w, code.wanted[0]), (h, code.wanted[1]))]
    places = [sorted({*range(b, n - side - b + 1, code.step), at, n - side - b}) for n, at in zip((w, h), wanted)]
    best = None
    for top in places[1]:
        for left in places[0]:
            g = guarded[top : top + side, left : left + side]
            at = ground[top : top + side, left : left + side].mean()
            corners = lambda k: [x.mean() for x in (g[:k, :k], g[:k, -k:], g[-k:, -k:], g[-k:, :k])]  # noqa: B023, E731
            common = g.mean() + min(at, 1 - at) * 0.45 + math.sqrt((left - wanted[0]) ** 2 + (top - wanted[1]) ** 2) / max(w, h) * 0.015
            for rotation, missing in ((0, 2), (90, 1), (180, 0), (270, 3)):
                c, f = ([x for i, x in enumerate(corners(k)) if i != missing] for k in (code.corner, code.finder))
                found = (round(common + sum(c) / 3 * 4 + max(c) * 2, 9), top, left, rotation, g.mean(), max(f))
                best = found if best is None or found[:4] < best[:4] else best
    return best


def plain_adaptive(guarded, ground, code, retries):
    h0, w0 = guarded.shape
    h, w, told = h0, w0, None
    for attempt in range(1, retries.most + 1):
        y, x = ((2 * np.arange(h) + 1) * h0) // (2 * h), ((2 * np.arange(w) + 1) * w0) // (2 * w)
        if best := plain_best(guarded[np.ix_(y, x)], ground[np.ix_(y, x)], code):
            told = (attempt, w, h, *best)
            if best[4] <= retries.guarded and best[5] <= retries.finder:
                break
        short, ratio = (int(min(w, h) * retries.growth) + retries.unit - 1) // retries.unit * retries.unit, w0 / h0
        w, h = (math.ceil(short * ratio / retries.unit) * retries.unit, short) if ratio >= 1 else (short, math.ceil(short / ratio / retries.unit) * retries.unit)
        if max(w, h) > retries.longest or code.side / min(w, h) < retries.least_share:
            break
    return told


@pytest.fixture(scope="module")
def pictures(spark):
    r = np.random.default_rng(4)
    made = {}
    for i, (h, w) in enumerate([(40, 64), (64, 40), (33, 47), (26, 26), (25, 60), (57, 30), (19, 19)]):
        made[i] = (r.random((h, w)) < (0.02, 0.2, 0.1)[i % 3], r.random((h, w)) < 0.6)
    rows = [(i, y, x, bool(a), None if b is None else bool(b)) for i, (g, k) in made.items() for (y, x), a, b in zip(np.ndindex(g.shape), g.ravel(), k.ravel())]
    labels = spark.createDataFrame(rows, "image int, y int, x int, guarded boolean, ground boolean")
    return made, labels, labels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def test_best_places_are_the_plain_ones(pictures):
    made, labels, sizes = pictures
    got = {r["image"]: (r["cost"], r["top"], r["left"], r["rotation"], r["guarded"], r["finder"]) for r in placement.best_places(labels, sizes, CODE).collect()}
    want = {i: b for i, m in made.items() if (b := plain_best(*m, CODE))}
    assert got.keys() == want.keys() and len(want) == 5
    for i, b in want.items():
        assert got[i][1:4] == b[1:4] and got[i] == pytest.approx(b)


def test_retries_are_the_plain_ones(pictures):
    made, labels, sizes = pictures
    got = {r["image"]: tuple(r[c] for c in ("attempt", "w", "h", "cost", "top", "left", "rotation", "guarded", "finder")) for r in placement.adaptive_places(labels, sizes, CODE, RETRIES).collect()}
    want = {i: b for i, m in made.items() if (b := plain_adaptive(*m, CODE, RETRIES))}
    assert {i: b[:3] for i, b in got.items()} == {i: b[:3] for i, b in want.items()}
    assert len({b[0] for b in want.values()}) > 1
    for i, b in want.items():
        assert got[i] == pytest.approx(b)


def test_places_of_nothing(pictures):
    _, labels, sizes = pictures
    assert placement.best_places(labels.where("false"), sizes.where("false"), CODE).collect() == []
    assert placement.adaptive_places(labels.where("false"), sizes.where("false"), CODE).collect() == []
    flat = labels.where("image = 0").withColumn("guarded", F.lit(None).cast("boolean"))
    assert placement.best_places(flat, sizes, CODE).first()["guarded"] == 0


def test_summed_areas_beyond_a_tile(spark):
    labels = spark.range(1100).select(F.lit(0).alias("image"), F.col("id").cast("int").alias("y"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).withColumn("v", F.col("y") % 7 + F.col("x"))
    got = {(r["y"], r["x"]): r["v"] for r in placement.summed_areas(labels, ["v"]).collect()}
    at = np.arange(1100)
    a = np.stack([at % 7, at % 7 + 1], axis=1).cumsum(0).cumsum(1)
    assert got == {(y + 1, x + 1): int(a[y, x]) for y in range(1100) for x in range(2)}


# --- smoothing and sizes ---


def as_rows(spark, pictures):
    return spark.createDataFrame([(i, y, [int(v) for v in row]) for i, p in pictures.items() for y, row in enumerate(p)], "image int, y int, v array<int>")


def as_arrays(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["image"], {})[r["y"]] = r["v"]
    return {i: np.array([rows[y] for y in sorted(rows)]) for i, rows in by.items()}


def half_up(x):
    return (x + 32768) >> 16


@pytest.mark.parametrize("sigma", [0.6, 2.0])
def test_smoothing_is_the_plain_one(spark, monkeypatch, sigma):
    monkeypatch.setattr(resample, "TILE_ROWS", 16)
    r = np.random.default_rng(1)
    made = {0: r.integers(0, 256, (37, 20)), 1: r.integers(0, 256, (1, 5)), 2: r.integers(0, 256, (64, 1))}
    kernel = resample.gaussian(sigma)
    assert sum(kernel) == resample.ONE and kernel == kernel[::-1]
    k = len(kernel) // 2
    got = as_arrays(resample.smoothed(as_rows(spark, made), kernel))
    assert got.keys() == made.keys()
    for i, p in made.items():
        h, w = p.shape
        across = half_up(sum(kernel[j + k] * p[:, np.clip(np.arange(w) + j, 0, w - 1)] for j in range(-k, k + 1)))
        assert (got[i] == half_up(sum(kernel[j + k] * across[np.clip(np.arange(h) + j, 0, h - 1)] for j in range(-k, k + 1)))).all()
    assert resample.smoothed(as_rows(spark, made).limit(0), kernel).collect() == []


@pytest.mark.parametrize("weights", [resample.area, resample.bilinear])
def test_resizing_is_the_plain_one(spark, weights):
    r = np.random.default_rng(2)
    made = {0: r.integers(0, 256, (37, 24)), 1: r.integers(0, 256, (12, 24)), 2: r.integers(0, 256, (1, 24))}
    targets = {0: 11, 1: 30, 2: 2}
    got = as_arrays(resample.resized(as_rows(spark, made), 24, 10, spark.createDataFrame(list(targets.items()), "image int, m int"), weights))
    for i, p in made.items():
        across = np.zeros((24, 10), dtype=np.int64)
        for o, s, w in weights(24, 10):
            across[s, o] = w
        down = np.zeros((targets[i], len(p)), dtype=np.int64)
        for o, s, w in weights(len(p), targets[i]):
            down[o, s] = w
        assert (down.sum(1) == resample.ONE).all() and (across.sum(0) == resample.ONE).all()
        assert (got[i] == half_up(down @ half_up(p @ across))).all()


def test_resizing_keeps_flat_pictures_and_sizes(spark):
    flat = {0: np.full((9, 24), 77)}
    got = as_arrays(resample.resized(as_rows(spark, flat), 24, 24, spark.createDataFrame([(0, 9)], "image int, m int"), resample.bilinear))
    assert (got[0] == 77).all() and got[0].shape == (9, 24)
    assert resample.area(4, 2) == [(0, 0, 32768), (0, 1, 32768), (1, 2, 32768), (1, 3, 32768)]


def test_block_correction_is_the_plain_loop(spark):
    r = random.Random(6)
    made, rows = {}, []
    for i, (h, w) in enumerate([(5, 9), (1, 4), (6, 1), (40, 33)]):
        low = np.array([[r.randrange(200) for _ in range(w)] for _ in range(h)])
        high = low + np.array([[r.choice([3, 24, 25, 60]) for _ in range(w)] for _ in range(h)])
        made[i] = (low, high, (low + high) // 2)
        rows += [(i, y, x, int(low[y, x]), int(high[y, x]), int(made[i][2][y, x])) for y in range(h) for x in range(w)]
    r.shuffle(rows)
    got = {(c["image"], c["gy"], c["gx"]): c["point"] for c in regions.corrected(spark.createDataFrame(rows, "image long, gy int, gx int, low int, high int, mean int")).collect()}
    want = {}
    for i, (low, high, mean) in made.items():
        out = mean.copy()
        for y, x in np.ndindex(out.shape):
            if high[y, x] - low[y, x] <= 24:
                out[y, x] = low[y, x] // 2
                if x and y and low[y, x] < (near := (out[y - 1, x] + 2 * out[y, x - 1] + out[y - 1, x - 1]) // 4):
                    out[y, x] = near
        want |= {(i, y, x): int(out[y, x]) for y, x in np.ndindex(out.shape)}
    assert got == want
