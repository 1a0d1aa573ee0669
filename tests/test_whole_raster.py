"""Queries without SQL that must take in every row of the raster."""

from quillgrid.functions import validators
from quillgrid.plans import catalog
from quillgrid.sources.tables import WIDTH, raster


def test_components_of_all_rows_equal_a_flood_fill(spark, sf_dir):
    left = {(r["y"], r["x"]) for r in raster(spark, sf_dir).where("v > 150").collect()}
    want = {}
    for cell in sorted(left):
        if cell not in want:
            edge, want[cell] = [cell], cell[0] * WIDTH + cell[1]
            while edge:
                y, x = edge.pop()
                for near in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                    if near in left and near not in want:
                        want[near] = want[cell]
                        edge.append(near)
    got = catalog.QUERIES["grid_components"](spark, sf_dir).collect()
    assert {(r["y"], r["x"]): r["label"] for r in got} == want and len(got) == len(want)
    assert max(y for y, _ in want) >= 48


def test_gif_holds_the_short_last_image(spark, sf_dir):
    rows = raster(spark, sf_dir).select("y").distinct().count()
    assert rows % 64  # the last image is short
    frames = 0
    for r in catalog.QUERIES["image_gif"](spark, sf_dir).collect():
        frames += [k for k, *_ in validators.gif_segments(bytes(r["gif"]))].count(b"image")
    assert frames == -(-rows // 64)
