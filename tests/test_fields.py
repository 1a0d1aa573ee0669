"""Spread offsets, pyramids, sampled codes, chunk orders, files and published tables against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import automaton, resample, sampling, spread
from quillgrid.sources import files, publish

# --- spreading ---


def plain_spread(offset, rounds, still):
    known = ~np.isnan(offset)
    field, moved = np.where(known, offset, 0.0), 0.0
    steps = 0
    while steps < rounds:
        for _ in range(min(spread.STEPS, rounds - steps)):
            p = np.pad(field, 1, constant_values=np.nan)
            near = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
            total, there = np.nan_to_num(near).sum(0), (~np.isnan(near)).sum(0)
            new = np.where(known | (there == 0), field, total / np.maximum(there, 1))
            moved, field = np.abs(new - field).max(), new
            steps += 1
        if moved <= still:
            break
    return field, moved


@pytest.mark.parametrize("rounds,still", [(12, 0.0), (48, 0.5)])
def test_spread_is_the_plain_field(spark, monkeypatch, rounds, still):
    monkeypatch.setattr(spread, "TILE_ROWS", 10)
    r = np.random.default_rng(3)
    made = {i: np.where(r.random(shape) < share, r.normal(0, 30, shape), np.nan) for i, (shape, share) in enumerate([((37, 9), 0.1), ((5, 5), 1.0), ((12, 6), 0.0), ((1, 7), 0.3), ((1, 1), 0.0)])}
    rows = [(i, y, [None if np.isnan(x) else float(x) for x in row]) for i, p in made.items() for y, row in enumerate(p)]
    got = spread.spread(spark.createDataFrame(rows, "image int, y int, offset array<double>"), rounds, still).collect()
    assert len(got) == len(rows)
    for i, p in made.items():
        field, moved = plain_spread(p, rounds, still)
        mine = sorted((g["y"], g["offset"], g["residual"]) for g in got if g["image"] == i)
        assert np.allclose([g[1] for g in mine], field, atol=1e-9)
        assert [g[2] for g in mine] == pytest.approx([moved] * len(p))
    assert spread.spread(spark.createDataFrame([], "image int, y int, offset array<double>")).collect() == []


# --- pyramids ---


@pytest.mark.parametrize("shape,levels", [((33, 21), 3), ((8, 8), 2), ((1, 5), 1)])
def test_pyramid_is_rebuilt(spark, shape, levels):
    r = np.random.default_rng(9)
    made = {i: r.integers(0, 256, shape) for i in range(2)}
    rows = spark.createDataFrame([(i, y, row.tolist()) for i, p in made.items() for y, row in enumerate(p)], "image int, y int, v array<int>")
    parts = resample.pyramid(rows, shape[1], levels)
    assert len(parts) == levels + 1
    back = {(g["image"], g["y"]): g["v"] for g in resample.rebuilt(parts, shape[1]).collect()}
    assert back == {(i, y): row.tolist() for i, p in made.items() for y, row in enumerate(p)}


def test_detail_is_given_back_where_wanted(spark):
    rows = lambda v: spark.createDataFrame([(0, 0, v)], "image int, y int, v array<int>")
    out = resample.strengthened(rows([10, 250, 7]), rows([13, 200, 9]), rows([10, 100, 9]), lambda x, s: s != 9).first()["v"]
    assert out == [12, 255, 7]  # 10 + 1.5 is rounded to even


# --- codes ---


def homography(corners, u, v):
    """Where (u, v) lies: solved from the four corners of the unit square."""
    a, b = [], []
    for (x, y), (s, t) in zip(corners, [(0, 0), (1, 0), (0, 1), (1, 1)]):
        a += [[s, t, 1, 0, 0, 0, -s * x, -t * x], [0, 0, 0, s, t, 1, -s * y, -t * y]]
        b += [x, y]
    h = np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1)
    x, y, w = h.reshape(3, 3) @ [u, v, 1]
    return x / w, y / w


def test_planted_codes_come_back(spark):
    r = random.Random(8)
    codes, pixels, planted = [], {}, {}
    shapes = {
        (0, 0): [(10, 10), (60, 14), (8, 58), None],  # turned and sheared, fourth point as it follows
        (0, 1): [(100, 20), (150, 25), (95, 80), (160, 90)],  # in perspective
        (1, 0): [(60, 60), (60, 10), (110, 60), None],  # a quarter turn
    }
    for (image, code), places in shapes.items():
        side = 21 if code == 0 else 25
        corner = [p for p in places if p] + ([] if places[3] else [(places[1][0] + places[2][0] - places[0][0], places[1][1] + places[2][1] - places[0][1])])
        bits = [[r.randrange(2) for _ in range(side)] for _ in range(side)]
        planted[image, code] = "".join(str(b) for row in bits for b in row)
        codes.append((image, code, side, *[c for p in places[:3] for c in p], *(places[3] or (None, None))))
        for row in range(side):
            for column in range(side):
                x, y = homography(corner, (column - 3) / (side - 7), (row - 3) / (side - 7))
                for d in (-1e-6, 1e-6):  # a middle may lie on a pixel's edge
                    for e in (-1e-6, 1e-6):
                        pixels[image, int(np.floor(y + d)), int(np.floor(x + e))] = bits[row][column]
    names = "image int, code int, side int, x0 int, y0 int, x1 int, y1 int, x2 int, y2 int, x3 int, y3 int"
    table = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "image int, y int, x int, v int")
    got = {(g["image"], g["code"]): g["squares"] for g in sampling.sampled(spark.createDataFrame(codes, names), table, F.col("v") == 1).collect()}
    assert got == planted


def test_codes_that_can_not_be_read(spark):
    names = "image int, code int, side int, x0 int, y0 int, x1 int, y1 int, x2 int, y2 int, x3 int, y3 int"
    pixels = spark.createDataFrame([(0, 0, 0, 1)], "image int, y int, x int, v int")
    codes = spark.createDataFrame([(0, 0, 9, None, 0, 5, 0, 0, 5, None, None), (0, 1, 9, 0, 0, 5, 5, 9, 9, 7, 7), (7, 2, 9, 0, 0, 2, 0, 0, 2, None, None)], names)
    assert {g["squares"] for g in sampling.sampled(codes, pixels, F.col("v") == 1).collect()} == {"?" * 81}
    plan = sampling.sampled(codes, pixels, F.col("v") == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert sampling.sampled(codes.limit(0), pixels, F.col("v") == 1).collect() == []


# --- orders ---


def test_states_are_those_of_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK", 4)
    r = random.Random(5)
    kinds = ["IHDR", "IDAT", "aiMd", "aiPd", "IEND", "other", "fcTL", None, "strange"]
    files_ = {0: ["IHDR", "IDAT", "IEND"], 1: ["IHDR", "other", "IDAT", "aiMd", "other", "aiPd", "IEND"], 2: ["IHDR"] + ["IDAT"] * 250 + ["IEND"], 3: ["IDAT"], 4: ["IHDR", "IDAT", "IEND", "other"]}
    for i in range(5, 60):
        files_[i] = (["IHDR"] if r.random() < 0.9 else []) + r.choices(kinds, [1, 30, 3, 3, 2, 20, 1, 1, 1], k=r.randint(1, 40)) + ["IEND"]
    rows = [(i, at, k) for i, ks in files_.items() for at, k in enumerate(ks)]
    r.shuffle(rows)
    got = {g["id"]: (g["state"], g["n"]) for g in automaton.ends(spark.createDataFrame(rows, "id int, at int, kind string"), "id", "at", "kind", automaton.PNG_ORDER).collect()}
    want = {}
    for i, ks in files_.items():
        state = automaton.PNG_ORDER.states[0]
        for k in ks:
            state = automaton.PNG_ORDER.step(k, state)
        want[i] = (state, len(ks))
    assert got == want
    assert {got[i][0] for i in range(5)} == {"picture", "package", "header", "extra"}


def test_kinds(spark):
    rows = spark.createDataFrame([("IHDR",), ("tEXt",), ("teXt",), ("text",), ("t1Xt",), (None,), ("IDATx",)], "t string")
    assert [g[0] for g in rows.select(automaton.kind_of(F.col("t"))).collect()] == ["IHDR", "other", "other", None, None, None, None]


# --- files ---


@pytest.fixture
def tree(tmp_path):
    for name, size in {"a.bin": 3, "one/b.bin": 10, "one/two/c.bin": 5, "one/two/three/d.bin": 1, "one/B.bin": 4, "one/note.txt": 2}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path)


def test_files_are_found_to_a_depth_and_once(spark, tree):
    told = lambda df: sorted((r["name"], r["depth"], r["length"]) for r in df.collect())
    assert told(files.discovered(spark, tree, "*.bin")) == [("a.bin", 0, 3), ("one/B.bin", 1, 4), ("one/two/c.bin", 2, 5)]
    assert told(files.discovered(spark, tree + "/", "*.bin", 0)) == [("a.bin", 0, 3)]
    assert told(files.discovered(spark, tree, "*.txt")) == [("one/note.txt", 1, 2)]


def test_content_is_read_only_where_asked(spark, tree):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan(files.discovered(spark, tree)).split("ReadSchema")[-1]
    got = {r["path"].split("/")[-1]: (r["content"], r["too_large"]) for r in files.contents(spark, tree, "*.bin", 4).collect()}
    assert got == {"a.bin": (b"xxx", False), "b.bin": (None, True), "c.bin": (None, True), "d.bin": (b"x", False), "B.bin": (b"xxxx", False)}
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,4)]" in plan(files.contents(spark, tree, "*", 4))


# --- published tables ---


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    rows = lambda n: spark.range(n).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    assert publish.current(spark, root) is None
    assert publish.published(rows(5), root)["rows"] == 5
    assert publish.current(spark, root).count() == 5

    # a run that ends after its data is written and before its manifest is
    real = publish.digest
    calls = []

    def stops(df):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(df)

    monkeypatch.setattr(publish, "digest", stops)
    with pytest.raises(KeyboardInterrupt):
        publish.published(rows(9), root)
    # one whose data is not what it was to be
    monkeypatch.setattr(publish, "digest", lambda df: (len(calls.append(1) or calls), 0))
    with pytest.raises(publish.Mismatch):
        publish.published(rows(7), root)
    monkeypatch.setattr(publish, "digest", real)
    assert sorted(r["id"] for r in publish.current(spark, root).collect()) == list(range(5))
    assert len(publish.swept(spark, root)) == 2
    publish.published(rows(3), root)
    old = publish.current(spark, root)
    publish.published(rows(0), root)
    assert old.count() == 3 and publish.current(spark, root).count() == 0
    assert publish.current(spark, root).columns == ["id", "text"]
    assert len(publish.swept(spark, root)) == 2


def test_digest_does_not_depend_on_order(spark):
    rows = spark.range(100)
    assert publish.digest(rows) == publish.digest(rows.orderBy(F.desc("id")).repartition(7))
    assert publish.digest(rows) != publish.digest(rows.withColumn("id", F.col("id") + 1))
    assert publish.digest(rows.limit(0)) == (0, 0)
