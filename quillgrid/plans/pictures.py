"""Queries over pictures: places of codes, smoothing, resizing, thresholds that go from block to block."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import placement, regions, resample, reveal, sampling, tones
from ..operators import spread as spreading
from ..sources.tables import table
from .catalog import IMG, PX, SIDES, _byte_sql, _images, _kept_folder, _two, query

CODE = placement.Code(side=24, finder=7, border=4)
RETRIES = placement.Retries(unit=8, least_share=0.12)

# --- places ------------------------------------------------------------------------------------------------------

_FAR = {n: CODE.side - s for n, s in (("corner", CODE.corner), ("finder", CODE.finder))}
_NEAR = {"corner": CODE.corner, "finder": CODE.finder}


def _corner_sql(name: str, i: int) -> str:
    low, high = f"< {_NEAR[name]}", f">= {_FAR[name]}"
    dy, dx = ((low, low), (low, high), (high, high), (high, low))[i]
    return f"sum(guarded) FILTER (WHERE dy {dy} AND dx {dx}) / {_NEAR[name] ** 2}.0::DOUBLE AS {name}{i}"


def _turn_sql(rotation: int, missing: int) -> str:
    a, b, d = (f"corner{i}" for i in range(4) if i != missing)
    finder = ", ".join(f"finder{i}" for i in range(4) if i != missing)
    return f"SELECT image, attempt, w, h, top, \"left\", {rotation} AS rotation, round(common + ({a} + {b} + {d}) / 3 * 4 + greatest({a}, {b}, {d}) * 2, 9) AS cost, whole AS guarded, greatest({finder}) AS finder FROM c"


def _places_sql(attempts: str) -> str:
    """The best place at every attempt (image, attempt, w0, h0, w, h): each pixel of each candidate square looked up on its own."""
    axis = lambda size: f"list_sort(list_distinct(list_concat(range({CODE.border}, {size} - {CODE.side} - {CODE.border} + 1, {CODE.step}), [{size} - {CODE.side} - {CODE.border}, {at(size)}])))"
    at = lambda size: f"greatest({CODE.border}, least({size} - {CODE.side} - {CODE.border}, greatest(0, least({size} - {CODE.side}, CAST(round_even({size} * 0.5::DOUBLE - {CODE.side / 2}::DOUBLE, 0) AS BIGINT)))))"
    return f"""att AS ({attempts}),
fits AS (SELECT *, {at("w")} AS wx, {at("h")} AS wy FROM att WHERE least(w, h) >= {CODE.side + 2 * CODE.border}),
p1 AS (SELECT *, unnest({axis("h")}) AS top FROM fits), p2 AS (SELECT *, unnest({axis("w")}) AS "left" FROM p1),
sq AS (SELECT dy, dx FROM (SELECT unnest(range({CODE.side})) AS dy), (SELECT unnest(range({CODE.side})) AS dx)),
lk AS (SELECT p2.*, dy, dx, ((2 * (top + dy) + 1) * h0) // (2 * h) AS y, ((2 * ("left" + dx) + 1) * w0) // (2 * w) AS x FROM p2, sq),
s AS (SELECT image, attempt, w, h, wx, wy, top, "left", sum(guarded) / {CODE.side**2}.0::DOUBLE AS whole, sum(ground) / {CODE.side**2}.0::DOUBLE AS ground, {", ".join(_corner_sql(n, i) for n in ("corner", "finder") for i in range(4))}
FROM lk JOIN (SELECT image, y, x, CAST(v > 150 AS INT) AS guarded, CAST(v < 127 AS INT) AS ground FROM img) USING (image, y, x) GROUP BY ALL),
c AS (SELECT *, whole + least(ground, 1 - ground) * {placement.MIXED}::DOUBLE + sqrt((("left" - wx) * ("left" - wx) + (top - wy) * (top - wy))::DOUBLE) / greatest(w, h) * {placement.FAR}::DOUBLE AS common FROM s),
t AS ({" UNION ALL ".join(_turn_sql(*t) for t in placement.TURNS)}),
best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY image, attempt ORDER BY cost, top, "left", rotation) = 1)"""


SIZES = "sz AS (SELECT image, 64 AS w0, max(y) + 1 AS h0 FROM img GROUP BY image)"


def _labels(spark, sf_dir):
    images = _images(spark, sf_dir)
    labels = images.select("image", "y", "x", (F.col("v") > 150).alias("guarded"), (F.col("v") < 127).alias("ground"))
    return labels, images.groupBy("image").agg(F.lit(64).alias("w"), (F.max("y") + 1).alias("h"))


@query(f"""WITH {PX}, {IMG}, {SIZES}, {_places_sql("SELECT image, 1 AS attempt, w0, h0, w0 AS w, h0 AS h FROM sz")}
SELECT image, top, "left", rotation, cost, round(guarded, 9) AS guarded, round(finder, 9) AS finder FROM best""")
def placement_search(spark, sf_dir):
    """The cheapest place and turn of a code over all places of a step grid, on every picture."""
    found = placement.best_places(*_labels(spark, sf_dir), CODE)
    return found.select("image", F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "rotation", "cost", F.round("guarded", 9).alias("guarded"), F.round("finder", 9).alias("finder"))


_SHORT = f"(CAST(floor(least(w, h) * {RETRIES.growth}::DOUBLE) AS BIGINT) + {RETRIES.unit - 1}) // {RETRIES.unit} * {RETRIES.unit}"


@query(f"""WITH RECURSIVE {PX}, {IMG}, {SIZES}, r AS (SELECT image, 1 AS attempt, w0::BIGINT AS w0, h0::BIGINT AS h0, w0::BIGINT AS w, h0::BIGINT AS h FROM sz
UNION ALL SELECT image, attempt + 1, w0, h0, nw, nh FROM (SELECT *, CASE WHEN w0 >= h0 THEN CAST(ceil(short * (w0 / h0::DOUBLE) / {RETRIES.unit}) AS BIGINT) * {RETRIES.unit} ELSE short END AS nw, CASE WHEN w0 >= h0 THEN short ELSE CAST(ceil(short / (w0 / h0::DOUBLE) / {RETRIES.unit}) AS BIGINT) * {RETRIES.unit} END AS nh
FROM (SELECT *, {_SHORT} AS short FROM r)) WHERE attempt < {RETRIES.most} AND greatest(nw, nh) <= {RETRIES.longest} AND {CODE.side} / least(nw, nh)::DOUBLE >= {RETRIES.least_share}::DOUBLE),
{_places_sql("SELECT * FROM r")}, ends AS (SELECT image, coalesce(min(attempt) FILTER (WHERE guarded <= {RETRIES.guarded}::DOUBLE AND finder <= {RETRIES.finder}::DOUBLE), max(attempt)) AS attempt FROM best GROUP BY image)
SELECT image, attempt, w, h, top, "left", rotation, cost, round(guarded, 9) AS guarded, round(finder, 9) AS finder FROM best JOIN ends USING (image, attempt)""")
def adaptive_placement(spark, sf_dir):
    """The same with retries on larger pictures where the place isn't free enough."""
    _kept_folder(spark)
    found = placement.adaptive_places(*_labels(spark, sf_dir), CODE, RETRIES)
    return found.select("image", "attempt", *[F.col(c).cast("long").alias(c) for c in ("w", "h", "top", "left")], "rotation", "cost", F.round("guarded", 9).alias("guarded"), F.round("finder", 9).alias("finder"))


# --- smoothing and sizes -----------------------------------------------------------------------------------------


def _rows(spark, sf_dir):
    """The pictures as rows of 64 values: a row of the table is a row of a picture, nothing is exploded."""
    value = lambda f: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((f.cast("double") + 1) * 127.5 + 0.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image"), (F.col("vec_id") % 64).cast("int").alias("y"), F.transform("embedding", value).alias("v"))


def _heights(rows, of):
    """(image, m): a new height of each picture, from its own."""
    return rows.groupBy("image").agg((F.max("y") + 1).alias("h")).select("image", of(F.col("h")).alias("m"))


def _pixels(rows):
    return rows.select("image", "y", F.posexplode("v").alias("x", "v"))


KERNEL = resample.gaussian(2.0)
_KERNEL_SQL = f"k AS (SELECT unnest(range({-(len(KERNEL) // 2)}, {len(KERNEL) // 2 + 1})) AS k, unnest({KERNEL}) AS w)"


@query(f"""WITH {PX}, {IMG}, {SIZES}, {_KERNEL_SQL}, a AS (SELECT i.image, i.y, i.x, CAST(sum(k.w * b.v) + 32768 AS BIGINT) >> 16 AS v FROM img i, k JOIN img b ON b.image = i.image AND b.y = i.y AND b.x = greatest(0, least(63, i.x + k.k)) GROUP BY ALL)
SELECT i.image, CAST(i.y AS INT) AS y, i.x, CAST(CAST(sum(k.w * b.v) + 32768 AS BIGINT) >> 16 AS INT) AS v FROM a i JOIN sz USING (image), k JOIN a b ON b.image = i.image AND b.x = i.x AND b.y = greatest(0, least(h0 - 1, i.y + k.k)) GROUP BY i.image, i.y, i.x""")
def gaussian_blur(spark, sf_dir):
    return _pixels(resample.smoothed(_rows(spark, sf_dir), KERNEL))


def _resize_sql(source: str, out: str, width: int, new_width: int, new_height: str, weight: str, reach: str = "0.0::DOUBLE") -> str:
    """`out` (image, y, x, v) from `source`, with the weights of both axes worked out by size."""
    ranked = "row_number() OVER (PARTITION BY n, m, o ORDER BY c DESC, i) = 1"
    return f"""{out}_z AS (SELECT image, max(y) + 1 AS n, {new_height.replace("h", "any_value(h0)")} AS m FROM {source} JOIN sz USING (image) GROUP BY image), {out}_n AS (SELECT DISTINCT n, m FROM {out}_z UNION SELECT {width}, {new_width}),
{out}_o AS (SELECT *, unnest(range(m)) AS o, unnest(range(m)) * n / m::DOUBLE AS low, (unnest(range(m)) + 1) * n / m::DOUBLE AS high FROM {out}_n), {out}_i AS (SELECT *, unnest(range(n)) AS i FROM {out}_o),
{out}_c AS (SELECT n, m, o, i, {weight.format(reach=reach)} AS c FROM {out}_i), {out}_f AS (SELECT *, CAST(floor(c / sum(c) OVER (PARTITION BY n, m, o) * 65536 + 0.5) AS BIGINT) AS f, {ranked} AS first FROM {out}_c WHERE c > 1e-9),
{out}_w AS (SELECT n, m, o, i, f + CASE WHEN first THEN 65536 - CAST(sum(f) OVER (PARTITION BY n, m, o) AS BIGINT) ELSE 0 END AS w FROM {out}_f),
{out}_a AS (SELECT image, y, o AS x, CAST(sum(w * v) + 32768 AS BIGINT) >> 16 AS v FROM {source} JOIN {out}_w ON i = x WHERE n = {width} AND m = {new_width} GROUP BY ALL),
{out} AS (SELECT image, o AS y, x, CAST(sum(w * v) + 32768 AS BIGINT) >> 16 AS v FROM {out}_a JOIN {out}_z USING (image) JOIN {out}_w USING (n, m) WHERE i = y GROUP BY ALL)"""


_AREA = "greatest(0.0::DOUBLE, least(high, i + 1) - greatest(low, i))"
_BILINEAR = "greatest(0.0::DOUBLE, 1 - abs((i + 0.5::DOUBLE) - (low + high) / 2) / {reach})"
_PIXELS_SQL = "SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS INT) AS v FROM"


@query(f"WITH {PX}, {IMG}, {SIZES}, {_resize_sql('img', 'small', 64, 24, '(h * 24 + 63) // 64', _AREA)} {_PIXELS_SQL} small")
def resized_area(spark, sf_dir):
    """Pictures at 24 of 64 of their size, by the mean of what each pixel covers."""
    rows = _rows(spark, sf_dir)
    return _pixels(resample.resized(rows, 64, 24, _heights(rows, lambda h: F.ceil(h * 24 / 64)), resample.area))


@query(f"WITH {PX}, {IMG}, {SIZES}, {_resize_sql('img', 'large', 64, 96, '(h * 96 + 63) // 64', _BILINEAR, '1.0::DOUBLE')} {_PIXELS_SQL} large")
def resized_bilinear(spark, sf_dir):
    """Pictures at one and a half times their size, bilinear."""
    rows = _rows(spark, sf_dir)
    return _pixels(resample.resized(rows, 64, 96, _heights(rows, lambda h: F.ceil(h * 96 / 64)), resample.bilinear))


@query(f"""WITH {PX}, {IMG}, {SIZES}, {_resize_sql('img', 'half', 64, 32, '(h + 1) // 2', _BILINEAR, 'greatest(1.0::DOUBLE, n / m::DOUBLE)')}, {_resize_sql('half', 'back', 32, 64, 'h', _BILINEAR, '1.0::DOUBLE')}
SELECT image, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS total, CAST(max(abs(a.v - b.v)) AS INT) AS most, count(*) AS pixels FROM img a JOIN back b USING (image, y, x) GROUP BY image""")
def half_size_loss(spark, sf_dir):
    """How much each picture differs from itself after it was at half its size and back: what a code on it has to stand."""
    rows = _rows(spark, sf_dir)
    half = resample.resized(rows, 64, 32, _heights(rows, lambda h: F.ceil(h / 2)), resample.bilinear)
    back = resample.resized(half, 32, 64, _heights(rows, lambda h: h), resample.bilinear)
    return resample.differences(rows, back)


# --- details, tones, codes ---------------------------------------------------------------------------------------

_WHOLE = "1.0::DOUBLE"
_DOWN = "greatest(1.0::DOUBLE, n / m::DOUBLE)"
_LEVEL_SQL = "SELECT image, {0} AS level, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS energy, CAST(max(abs(a.v - b.v)) AS INT) AS most, count(*) AS pixels FROM {1} a JOIN {2} b USING (image, y, x) GROUP BY image"


@query(f"""WITH {PX}, {IMG}, {SIZES}, {_resize_sql('img', 'half', 64, 32, '(h + 1) // 2', _BILINEAR, _DOWN)}, {_resize_sql('half', 'back', 32, 64, 'h', _BILINEAR, _WHOLE)},
{_resize_sql('half', 'quarter', 32, 16, '((h + 1) // 2 + 1) // 2', _BILINEAR, _DOWN)}, {_resize_sql('quarter', 'again', 16, 32, '(h + 1) // 2', _BILINEAR, _WHOLE)}
{_LEVEL_SQL.format(0, 'img', 'back')} UNION ALL {_LEVEL_SQL.format(1, 'half', 'again')}""")
def detail_levels(spark, sf_dir):
    """How much detail each picture has at two scales."""
    out = None
    for level, part in enumerate(resample.pyramid(_rows(spark, sf_dir), 64, 2)[:-1]):
        row = part.select("image", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("e"), F.array_max(F.transform("v", F.abs)).alias("m"), F.size("v").alias("n"))
        told = row.groupBy("image").agg(F.lit(level).alias("level"), F.sum("e").alias("energy"), F.max("m").alias("most"), F.sum("n").alias("pixels"))
        out = told if out is None else out.unionByName(told)
    return out


@query(f"""WITH {PX}, {IMG}, {SIZES}, {_KERNEL_SQL}, a AS (SELECT i.image, i.y, i.x, CAST(sum(k.w * b.v) + 32768 AS BIGINT) >> 16 AS v FROM img i, k JOIN img b ON b.image = i.image AND b.y = i.y AND b.x = greatest(0, least(63, i.x + k.k)) GROUP BY ALL),
g AS (SELECT i.image, i.y, i.x, CAST(sum(k.w * b.v) + 32768 AS BIGINT) >> 16 AS v FROM a i JOIN sz USING (image), k JOIN a b ON b.image = i.image AND b.x = i.x AND b.y = greatest(0, least(h0 - 1, i.y + k.k)) GROUP BY i.image, i.y, i.x)
SELECT image, CAST(y AS INT) AS y, x, CAST(CASE WHEN img.v BETWEEN 100 AND 150 AND img.v <> g.v THEN round_even(least(255.0::DOUBLE, greatest(0.0::DOUBLE, g.v + (img.v - g.v) * 0.5::DOUBLE)), 0) ELSE g.v END AS INT) AS v FROM img JOIN g USING (image, y, x)""")
def fabric_detail(spark, sf_dir):
    """Smoothed pictures with half of their fine detail given back where their tones are a garment's."""
    rows = _rows(spark, sf_dir)
    smooth = resample.smoothed(rows, KERNEL)
    return _pixels(resample.strengthened(smooth, rows, smooth, lambda shown, s: s.between(100, 150) & (s != shown)))


TONES, STEPS = (100, 155), 16


@query(f"""WITH RECURSIVE {PX}, {IMG}, k AS (SELECT image, y, x, CASE WHEN v < {TONES[0]} THEN {TONES[0]}.0::DOUBLE - v WHEN v > {TONES[1]} THEN {TONES[1]}.0::DOUBLE - v END AS o FROM img),
r AS (SELECT 0 AS step, image, y, x, coalesce(o, 0.0::DOUBLE) AS f, o IS NOT NULL AS known, 0.0::DOUBLE AS moved FROM k
UNION ALL SELECT step + 1, image, y, x, new, known, abs(new - f) FROM (SELECT *, CASE WHEN known THEN f ELSE (coalesce(u, 0.0::DOUBLE) + coalesce(d, 0.0::DOUBLE) + coalesce(l, 0.0::DOUBLE) + coalesce(g, 0.0::DOUBLE)) / ((u IS NOT NULL)::INT + (d IS NOT NULL)::INT + (l IS NOT NULL)::INT + (g IS NOT NULL)::INT) END AS new
FROM (SELECT *, lag(f) OVER v AS u, lead(f) OVER v AS d, lag(f) OVER h AS l, lead(f) OVER h AS g FROM r WHERE step < {STEPS} WINDOW v AS (PARTITION BY image, x ORDER BY y), h AS (PARTITION BY image, y ORDER BY x))))
SELECT image, CAST(y AS INT) AS y, x, round(f, 6) AS "offset", round(max(moved) OVER (PARTITION BY image), 6) AS residual FROM r WHERE step = {STEPS}""")
def tone_spread(spark, sf_dir):
    """What dark and light pixels lack to tones in between, spread smoothly over the others; and how much it still moves."""
    _kept_folder(spark)
    offset = lambda v: F.when(v < TONES[0], F.lit(float(TONES[0])) - v).when(v > TONES[1], F.lit(float(TONES[1])) - v)
    rows = _rows(spark, sf_dir).select("image", "y", F.transform("v", offset).alias("offset"))
    found = spreading.spread(rows, STEPS, still=0.0)
    return found.select("image", "y", F.posexplode("offset").alias("x", "o"), F.round("residual", 6).alias("residual")).select("image", "y", "x", F.round("o", 6).alias("offset"), "residual")


SIDE = 21
_CORNER = "arg_max([y, x], [v, -y, -x]) FILTER (WHERE y < 20 AND x < 20) AS a, arg_max([y, x], [v, -y, -x]) FILTER (WHERE y < 20 AND x >= 44) AS b, arg_max([y, x], [v, -y, -x]) FILTER (WHERE y >= 20 AND x < 20) AS c"
_UNIT = f"({{0}} + 0.5::DOUBLE - 3.5::DOUBLE) / {SIDE - 7}"


@query(f"""WITH {PX}, {IMG}, q AS (SELECT image, {_CORNER} FROM img GROUP BY image), e AS (SELECT unnest(range({SIDE})) AS n),
s AS (SELECT image, r.n AS rr, c.n AS cc, floor(((b[2] - a[2]) * u + (q.c[2] - a[2]) * w + a[2]) / 1.0::DOUBLE)::BIGINT AS x, floor(((b[1] - a[1]) * u + (q.c[1] - a[1]) * w + a[1]) / 1.0::DOUBLE)::BIGINT AS y FROM (SELECT *, {_UNIT.format('n')} AS w FROM e) r, (SELECT *, {_UNIT.format('n')} AS u FROM e) c, q WHERE b IS NOT NULL AND q.c IS NOT NULL)
SELECT image, string_agg(CASE WHEN v > 127 THEN '1' WHEN v IS NULL THEN '?' ELSE '0' END, '' ORDER BY rr, cc) AS squares FROM s LEFT JOIN img USING (image, y, x) GROUP BY image""")
def sampled_codes(spark, sf_dir):
    """The squares of a code on each picture whose corners are the lightest pixels of three of its corners."""
    p = _images(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    best = lambda where: F.max_by(F.when(where, F.struct("y", "x")), F.when(where, F.struct("v", -y, -x)))
    found = p.groupBy("image").agg(best((y < 20) & (x < 20)).alias("a"), best((y < 20) & (x >= 44)).alias("b"), best((y >= 20) & (x < 20)).alias("c")).dropna()
    none = F.lit(None).cast("int")
    codes = found.select("image", F.lit(0).alias("code"), F.lit(SIDE).alias("side"), *[F.col(f"{n}.{axis}").alias(f"{axis}{i}") for i, n in enumerate("abc") for axis in "xy"], none.alias("x3"), none.alias("y3"))
    return sampling.sampled(codes, p, F.col("v") > 127).select("image", "squares")


_AMOUNT = f"CASE WHEN (mx < 8 AND my < 8) OR (mx >= 13 AND my < 8) OR (mx < 8 AND my >= 13) OR mx = 6 OR my = 6 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (level / 2 + {tones.FADE}::DOUBLE - greatest(abs((x % 3 + 0.5::DOUBLE) / 3 - 0.5::DOUBLE), abs((y % 3 + 0.5::DOUBLE) / 3 - 0.5::DOUBLE))) / {tones.FADE}::DOUBLE)) END"


def _part_sql(c: str) -> str:
    new = f"CASE WHEN ink THEN {c} * least(1.0::DOUBLE, {tones.DARK}::DOUBLE / greatest(light, 0.001::DOUBLE)) ELSE {c} + (1 - {c}) * greatest(0.0::DOUBLE, ({tones.LIGHT}::DOUBLE - light) / greatest(1 - light, 0.001::DOUBLE)) END"
    return f"CASE WHEN mx < 21 AND my < 21 THEN CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, ({c} * (1 - amount) + ({new}) * amount) * 255))) AS INT) ELSE {c}0 END"


@query(f"""WITH {PX}, {IMG}, s AS (SELECT image, CAST(y AS INT) AS y, x, y // 3 AS my, x // 3 AS mx, v AS r0, (v * 3) % 256 AS g0, (v * 5) % 256 AS b0, (y // 3 * 7 + x // 3 * 3 + image) % 5 < 2 AS ink FROM img),
c AS (SELECT *, r0 / 255.0::DOUBLE AS r, g0 / 255.0::DOUBLE AS g, b0 / 255.0::DOUBLE AS b, unnest({list(tones.LEVELS)}::DOUBLE[]) AS level FROM s),
l AS (SELECT *, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS light, {_AMOUNT} AS amount FROM c)
SELECT image, y, x, level, {_part_sql('r')} AS red, {_part_sql('g')} AS green, {_part_sql('b')} AS blue FROM l""")
def contrast_levels(spark, sf_dir):
    """Every picture with the squares of a code made readable, at four levels."""
    v, y, x = F.col("v"), F.col("y"), F.col("x")
    ink = (F.floor(y / 3) * 7 + F.floor(x / 3) * 3 + F.col("image")) % 5 < 2
    p = _images(spark, sf_dir).withColumn("level", F.explode(F.array(*map(F.lit, tones.LEVELS))))
    out = tones.refined(y, x, [v, v * 3 % 256, v * 5 % 256], ink, 0, 0, 3, 21, F.col("level"))
    return p.select("image", "y", "x", "level", *[c.alias(n) for c, n in zip(out, ("red", "green", "blue"))])


# --- profiles, looks, cells --------------------------------------------------------------------------------------

_QUANTILES = {"q01": 10, "q02": 20, "q50": 500, "q98": 980, "q99": 990}


def _quantiles_sql(of: str, prefix: str) -> str:
    picks = ", ".join(f"min(bin) FILTER (WHERE upto >= greatest(1, (total * {q} + 999) // 1000)) AS {prefix}{n}" for n, q in _QUANTILES.items())
    return f"SELECT image, {picks} FROM (SELECT image, bin, sum(n) OVER (PARTITION BY image ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY image) AS total FROM (SELECT image, {of} AS bin, count(*) AS n FROM img GROUP BY ALL)) GROUP BY image"


@query(f"""WITH {PX}, {IMG}, d AS ({_quantiles_sql('v', 'd_')}), w AS ({_quantiles_sql('v * 7 % 256', 'w_')})
SELECT image, w_q02 AS white_low, w_q98 AS white_high, d_q01 AS black_low, d_q99 AS black_high, CAST(greatest(184, least(196, 190 + trunc((d_q50 - 128) / 24.0::DOUBLE))) AS INT) AS white_floor, CASE WHEN d_q98 - d_q02 < 30 THEN 145 ELSE 165 END AS black_ceiling,
round(greatest(0.45::DOUBLE, least(0.65::DOUBLE, 0.56::DOUBLE + (128 - d_q50) / 1024.0::DOUBLE)), 9) AS exposure, round(greatest(16.0::DOUBLE, least(48.0::DOUBLE, 16 + 80 * 0.32::DOUBLE - greatest(0, d_q98 - d_q02 - 96) / 48.0::DOUBLE)), 9) AS chroma_limit FROM d JOIN w USING (image)""")
def picture_profiles(spark, sf_dir):
    """What each pair of pictures is tuned by: five quantiles of either, and the bounds, exposure and colour limit they give."""
    v = F.col("v")
    p = _images(spark, sf_dir).select("image", F.explode(F.array(F.struct(F.lit("d").alias("of"), v.alias("bin")), F.struct(F.lit("w").alias("of"), (v * 7 % 256).alias("bin")))).alias("x"))
    h = p.groupBy("image", "x.of", "x.bin").agg(F.count("*").alias("n"))  # 256 bins a picture at most
    w = Window.partitionBy("image", "of")
    h = h.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    q = h.groupBy("image").agg(*[F.min(F.when((F.col("of") == of) & (F.col("upto") >= F.greatest(F.lit(1), F.floor((F.col("total") * k + 999) / 1000))), F.col("bin"))).alias(f"{of}_{n}") for of in "dw" for n, k in _QUANTILES.items()])
    middle, contrast = F.col("d_q50"), F.col("d_q98") - F.col("d_q02")
    bounded = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return q.select(
        "image", F.col("w_q02").alias("white_low"), F.col("w_q98").alias("white_high"), F.col("d_q01").alias("black_low"), F.col("d_q99").alias("black_high"),
        bounded(190 + F.expr("(d_q50 - 128) DIV 24"), 184, 196).cast("int").alias("white_floor"), F.when(contrast < 30, 145).otherwise(165).alias("black_ceiling"),
        F.round(bounded((128 - middle) / F.lit(1024.0) + 0.56, 0.45, 0.65), 9).alias("exposure"), F.round(bounded(16 + 80 * F.lit(0.32) - F.greatest(F.lit(0), contrast - 96) / F.lit(48.0), 16.0, 48.0), 9).alias("chroma_limit"),
    )


@query(f"""WITH {PX}, {SIDES}, u AS (SELECT *, (299 * lr + 587 * lg + 114 * lb) / 1000.0::DOUBLE AS ly, (299 * dr + 587 * dg + 114 * db) / 1000.0::DOUBLE AS dy FROM s),
b AS (SELECT y, x, ly, {", ".join(f"(dy + ({c} - dy) * 0.75::DOUBLE) * 0.5::DOUBLE AS {n}" for c, n in (("dr", "br"), ("dg", "bg"), ("db", "bb")))} FROM u),
o AS (SELECT *, greatest(CAST(ceil(greatest(br, bg, bb)) AS INT), {_byte_sql("255 + (br + bg + bb) / 3 - (ly * 0.5::DOUBLE + 127.5::DOUBLE)")}) AS a FROM b)
SELECT y, x, a AS opacity, {", ".join(f"CASE WHEN a = 0 THEN 0 ELSE {_byte_sql(f'{c} * 255 / a')} END AS {n}" for c, n in (("br", "red"), ("bg", "green"), ("bb", "blue")))} FROM o""")
def dark_first_pixels(spark, sf_dir):
    """Two pictures in one, of which the dark one shows exactly."""
    p, light, dark = _two(spark, sf_dir)
    a, out = reveal.dark_first(light, dark, 0.75)
    return p.select("y", "x", a.alias("opacity"), *[c.alias(n) for c, n in zip(out, ("red", "green", "blue"))])


_BOXES = 'b AS (SELECT l_suppkey AS image, l_quantity::INT * 6 AS "left", (l_orderkey % 50)::INT * 6 AS top, (4 + l_linenumber)::INT AS wide, (4 + l_partkey % 5)::INT AS high FROM lineitem)'


@query(f"""WITH {_BOXES}, n AS (SELECT *, row_number() OVER () AS id FROM b)
SELECT a.image, a."left", a.top, a.wide, a.high, count(*) AS near FROM n a JOIN n c ON a.image = c.image AND abs(a.wide - c.wide) <= 2 AND abs(a.high - c.high) <= 2 AND abs(a."left" - c."left") < a.wide * 3.6::DOUBLE AND abs(a.top - c.top) < a.high * 3.6::DOUBLE GROUP BY a.id, a.image, a."left", a.top, a.wide, a.high HAVING count(*) >= 8""")
def similar_cells(spark, sf_dir):
    """Cells of a picture that have seven others of their size around them: what hides something as a mosaic does."""
    line = table(spark, sf_dir, "lineitem")
    boxes = line.select(F.col("l_suppkey").alias("image"), (F.col("l_quantity").cast("int") * 6).alias("left"), (F.col("l_orderkey") % 50 * 6).cast("int").alias("top"), (4 + F.col("l_linenumber")).cast("int").alias("wide"), (4 + F.col("l_partkey") % 5).cast("int").alias("high"))
    return regions.alike_nearby(boxes, "image")
