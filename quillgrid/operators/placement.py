"""Where a square code may stand on a picture: sums over all candidate squares from summed areas, and retries on larger pictures.

Labels are rows (image, y, x, guarded, ground) of pictures (image, w, h): `guarded` says that a pixel is kept free if possible,
`ground` that it is background. A code has `side` pixels, stands at least `border` from the edges and is tried at steps of
max(8, side // 20), at the nearest place to the wanted one, and at the last that fits. What a place costs: the guarded share
under it, 0.45 of the smaller share of ground or figure (a code should lie on one of them), its distance from the wanted place,
and the guarded shares of the three corners that have markers, whose quarter turn is chosen with it.

Cases: a picture that the code does not fit on, and one without pixels, has no place and no row; a null flag is false; ties
go to the upper, then the left place, then the smaller turn; repeated pixels count as often; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS = 512
#: The corner without a marker (of the four clockwise from the upper left) at each quarter turn.
TURNS = ((0, 2), (90, 1), (180, 0), (270, 3))
MIXED, FAR = 0.45, 0.015


@dataclass(frozen=True)
class Code:
    """A square code. corner: the side of what is looked at in its corners; finder: of a marker; wanted: where its middle should
    be, as shares of the picture's width and height."""

    side: int
    finder: int
    border: int = 16
    wanted: tuple[float, float] = (0.5, 0.5)

    @property
    def corner(self) -> int:
        return min(self.side, max(8, self.side // 5))

    @property
    def step(self) -> int:
        return max(8, self.side // 20)


def summed_areas(labels: DataFrame, values: list[str]) -> DataFrame:
    """(image, y, x, values): each value summed over all pixels above and left of a corner point (y, x), for the points right
    and below of pixels; rows are summed in their order, columns within tiles of rows plus the tiles above."""
    along = Window.partitionBy("image", "y").orderBy("x")
    rows = labels.select("image", "y", "x", *[F.sum(v).over(along).alias(v) for v in values]).withColumn("tile", F.floor(F.col("y") / TILE_ROWS))
    above = Window.partitionBy("image", "x").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = rows.groupBy("image", "x", "tile").agg(*[F.sum(v).alias(v) for v in values])
    before = tiles.select("image", "x", "tile", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"_{v}") for v in values])
    down = Window.partitionBy("image", "x", "tile").orderBy("y")
    summed = rows.join(before, ["image", "x", "tile"])
    return summed.select("image", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), *[(F.sum(v).over(down) + F.col(f"_{v}")).alias(v) for v in values])


def tried(code: Code, size: Column, wanted: float) -> tuple[Column, Column]:
    """The candidate offsets along an axis of `size` pixels, and the one that is wanted."""
    last = size - code.side - code.border
    at = F.greatest(F.lit(0), F.least(size - code.side, F.rint(size * F.lit(wanted) - code.side / 2).cast("int")))
    at = F.greatest(F.lit(code.border), F.least(last, at))
    steps = F.when(last >= code.border, F.sequence(F.lit(code.border), F.greatest(last, F.lit(code.border)), F.lit(code.step))).otherwise(F.array().cast("array<int>"))
    return F.when(last >= code.border, F.array_sort(F.array_distinct(F.concat(steps, F.array(at, last))))).otherwise(steps), at


def _boxes(code: Code) -> dict[str, tuple[int, int, int]]:
    """Squares of a code: down, right, side."""
    out = {"whole": (0, 0, code.side)}
    for name, size in (("corner", code.corner), ("finder", code.finder)):
        far = code.side - size
        out |= {f"{name}{i}": (*at, size) for i, at in enumerate(((0, 0), (0, far), (far, far), (far, 0)))}
    return out


def candidates(labels: DataFrame, pictures: DataFrame, code: Code) -> DataFrame:
    """(image, top, left, guarded share of the whole, of each corner and finder; ground share): one row for each place tried.

    Each corner point of the summed areas is sent to the places that look it up, with the signs it has there: an offset equi-join
    by addition, of (corners of all squares) x (places) rows in all whatever the side.
    """
    flags = labels.select("image", "y", "x", *[F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in ("guarded", "ground")])
    down, _ = tried(code, F.col("h"), code.wanted[1])
    right, _ = tried(code, F.col("w"), code.wanted[0])
    grid = pictures.select("image", down.alias("tops"), right.alias("lefts"))  # a row for each picture
    boxes = _boxes(code)
    offsets = sorted({b for dy, _, s in boxes.values() for b in (dy, dy + s)})
    points = summed_areas(flags, ["guarded", "ground"]).join(grid, "image")
    served = lambda at, places: F.filter(F.transform(F.array(*map(F.lit, offsets)), lambda o: F.struct((F.col(at) - o).cast("int").alias("place"), o.alias("o"))), lambda s: F.array_contains(F.col(places), s["place"]))
    near = points.withColumn("dy", served("y", "tops")).where(F.size("dy") > 0).withColumn("dx", served("x", "lefts")).where(F.size("dx") > 0)
    sent = near.withColumn("dy", F.explode("dy")).withColumn("dx", F.explode("dx"))
    sign = lambda at, low, size: F.when(F.col(f"{at}.o") == low, -1).when(F.col(f"{at}.o") == low + size, 1).otherwise(0)
    total = lambda b, value: F.sum(sign("dy", b[0], b[2]) * sign("dx", b[1], b[2]) * F.col(value))
    share = lambda b, value: total(b, value) / F.lit(float(b[2] ** 2))
    summed = sent.groupBy("image", F.col("dy.place").alias("top"), F.col("dx.place").alias("left")).agg(*[share(b, "guarded").alias(n) for n, b in boxes.items()], share(boxes["whole"], "ground").alias("ground"))
    return summed


def best_places(labels: DataFrame, pictures: DataFrame, code: Code) -> DataFrame:
    """(image, top, left, rotation, cost, guarded, finder): the cheapest place of each picture with its guarded share and the
    largest of its three markers'."""
    _, wanted_y = tried(code, F.col("h"), code.wanted[1])
    _, wanted_x = tried(code, F.col("w"), code.wanted[0])
    c = candidates(labels, pictures, code).join(pictures.select("image", "w", "h"), "image")
    away = F.sqrt(((F.col("left") - wanted_x) * (F.col("left") - wanted_x) + (F.col("top") - wanted_y) * (F.col("top") - wanted_y)).cast("double"))
    common = F.col("whole") + F.least(F.col("ground"), 1 - F.col("ground")) * MIXED + away / F.greatest("w", "h") * FAR

    def turn(rotation: int, missing: int) -> Column:
        kept = [i for i in range(4) if i != missing]
        a, b, d = (F.col(f"corner{i}") for i in kept)
        return F.struct(F.round(common + (a + b + d) / 3 * 4 + F.greatest(a, b, d) * 2, 9).alias("cost"), "top", "left", F.lit(rotation).alias("rotation"), F.col("whole").alias("guarded"), F.greatest(*[F.col(f"finder{i}") for i in kept]).alias("finder"))

    turns = F.array_min(F.array(*[turn(*t) for t in TURNS]))
    return c.groupBy("image").agg(F.min(turns).alias("b")).select("image", "b.top", "b.left", "b.rotation", "b.cost", "b.guarded", "b.finder")


def enlarged(labels: DataFrame, pictures: DataFrame) -> DataFrame:
    """Labels at the sizes (w, h) of `pictures`, each pixel of which takes the nearest one of the original (w0, h0)."""
    p = labels.join(pictures, "image")

    def takes(at: str, size: str, old: str) -> Column:
        # the first pixel whose middle lies in i or later: i * size / old - 1/2 rounded up, in whole numbers
        first = lambda i: F.floor((i * 2 * F.col(size) + F.col(old) - 1) / (F.col(old) * 2)).cast("int")
        low, high = F.greatest(F.lit(0), first(F.col(at))), F.least(F.col(size), first(F.col(at) + 1))
        return F.when(high > low, F.sequence(low, high - 1))

    rows = p.withColumn("_y", F.explode(takes("y", "h", "h0")))
    return rows.withColumn("_x", F.explode(takes("x", "w", "w0"))).select("image", F.col("_y").alias("y"), F.col("_x").alias("x"), "guarded", "ground")


@dataclass(frozen=True)
class Retries:
    """How a place is looked for again: on pictures 1.12 times as large, in sizes that are multiples of `unit`, `most` times at most,
    while the code fills at least `least_share` of the shorter side and no side is above `longest`; guarded and finder are the
    shares with which a place is good."""

    guarded: float = 0.12
    finder: float = 0.005
    unit: int = 64
    least_share: float = 0.30
    longest: int = 3072
    most: int = 9
    growth: float = 1.12

    def next_size(self) -> tuple[Column, Column]:
        """Width and height of the next attempt from (w, h) and the original (w0, h0)."""
        up = lambda c: F.ceil(c / self.unit).cast("int") * self.unit
        short = F.floor((F.floor(F.least("w", "h") * F.lit(self.growth)) + (self.unit - 1)) / self.unit).cast("int") * self.unit
        ratio = F.col("w0") / F.col("h0")
        return F.when(ratio >= 1, up(short * ratio)).otherwise(short), F.when(ratio >= 1, short).otherwise(up(short / ratio))


def adaptive_places(labels: DataFrame, pictures: DataFrame, code: Code, retries: Retries = Retries()) -> DataFrame:
    """(image, attempt, w, h, top, left, rotation, cost, guarded, finder): the place on the first size where it is good, else
    on the last one tried.

    A round works on the pictures that are still open; those with a good place, or with no larger size allowed, leave. Rounds are
    at most `most`, and only whether any picture is open comes to the driver; lineage is cut after each.
    """
    open_ = pictures.select("image", F.col("w").alias("w0"), F.col("h").alias("h0"), "w", "h")
    done = None
    for attempt in range(1, retries.most + 1):
        at_size = labels if attempt == 1 else enlarged(labels, open_)
        placed = best_places(at_size, open_, code).withColumn("attempt", F.lit(attempt))
        w, h = retries.next_size()
        told = open_.join(placed, "image", "left").withColumn("next_w", w).withColumn("next_h", h)
        good = (F.col("guarded") <= retries.guarded) & (F.col("finder") <= retries.finder)
        further = (F.greatest("next_w", "next_h") <= retries.longest) & (code.side / F.least("next_w", "next_h") >= retries.least_share)
        stays = ~F.coalesce(good, F.lit(False)) & further & F.lit(attempt < retries.most)
        told = told.withColumn("stays", stays).checkpoint()
        left = told.where("NOT stays AND top IS NOT NULL").select("image", "attempt", "w", "h", "top", "left", "rotation", "cost", "guarded", "finder")
        done = left if done is None else done.unionByName(left)
        open_ = told.where("stays").select("image", "w0", "h0", F.col("next_w").alias("w"), F.col("next_h").alias("h"))
        if attempt == retries.most or open_.isEmpty():
            return done
    return done
