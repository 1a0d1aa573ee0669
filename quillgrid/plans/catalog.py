"""All queries over the driver tables, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaners, containers, graphs, images, metadata, naming, packaging, prompts, qr, validators
from ..operators import models, permutation, regions, reveal
from ..operators import raster as ops
from ..sources.ordered import by_key
from ..sources.tables import WIDTH, ranked, raster, table
from ..streaming.events import latest
from ..streaming.history import active, replayed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PX = "px AS (SELECT y, x, CAST(least(255, greatest(0, floor((CAST(embedding[x + 1] AS DOUBLE) + 1) * 127.5 + 0.5))) AS INT) AS v FROM (SELECT vec_id AS y, CAST(unnest(range(64)) AS INT) AS x, embedding FROM embeddings))"
LINE = "line AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, CAST(l_quantity AS INT) AS v FROM lineitem), n AS (SELECT count(*) AS n FROM lineitem)"
LIVE_TYPES = ("purchase", "click", "view")


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its own name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def height(pixels: DataFrame) -> int:
    last = pixels.agg(F.max("y")).first()[0]
    return 0 if last is None else last + 1


# --- histograms and profiles -------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT v AS bin, count(*) AS n FROM px GROUP BY v")
def luma_histogram(spark, sf_dir):
    return raster(spark, sf_dir).groupBy(F.col("v").alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT CAST(l_quantity AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h), f AS (SELECT unnest([10, 20, 500, 980, 990]) AS per_mille)
SELECT per_mille, min(bin) FILTER (WHERE upto >= greatest(1, (total * per_mille + 999) // 1000)) AS bin FROM c, f GROUP BY per_mille""")
def histogram_quantiles(spark, sf_dir):
    h = ops.running(table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("bin")).agg(F.count("*").alias("n")))
    wanted = h.withColumn("per_mille", F.explode(F.array(*map(F.lit, (10, 20, 500, 980, 990)))))
    return wanted.groupBy("per_mille").agg(ops.quantile(wanted, F.col("per_mille")).alias("bin"))


@query(f"""WITH {PX}, h AS (SELECT v AS bin, count(*) AS n FROM px GROUP BY v), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h)
SELECT min(bin) FILTER (WHERE upto >= greatest(1, (total * 20 + 999) // 1000)) AS low, min(bin) FILTER (WHERE upto >= greatest(1, (total * 500 + 999) // 1000)) AS middle,
min(bin) FILTER (WHERE upto >= greatest(1, (total * 980 + 999) // 1000)) AS high FROM c""")
def tone_profile(spark, sf_dir):
    h = ops.running(raster(spark, sf_dir).groupBy(F.col("v").alias("bin")).agg(F.count("*").alias("n")))
    return h.agg(*[ops.quantile(h, F.lit(q)).alias(name) for q, name in ((20, "low"), (500, "middle"), (980, "high"))])


# --- pixel arithmetic --------------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT y, x, CAST(((v * 7) % 256 * v + 255 * (255 - v) + 127) // 255 AS INT) AS out FROM px")
def flatten_over_background(spark, sf_dir):
    return raster(spark, sf_dir).select("y", "x", F.expr("CAST(((v * 7) % 256 * v + 255 * (255 - v) + 127) DIV 255 AS INT)").alias("out"))


@query(f"""WITH {PX}, s AS (SELECT y, x, v AS a, (v * 7) % 256 AS c FROM px)
SELECT y, x, CAST(least(255, greatest(0, floor(c * a / 255.0::DOUBLE + 255 * (255 - a) / 255.0::DOUBLE + 0.5))) AS INT) AS on_white, CAST(least(255, greatest(0, floor(c * a / 255.0::DOUBLE + 0.5))) AS INT) AS on_black FROM s""")
def render_pair(spark, sf_dir):
    s = raster(spark, sf_dir).select("y", "x", F.col("v").alias("a"), (F.col("v") * 7 % 256).alias("c"))
    shown = lambda ground: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("c") * F.col("a") / F.lit(255.0) + ground + 0.5))).cast("int")
    return s.select("y", "x", shown(255 * (255 - F.col("a")) / F.lit(255.0)).alias("on_white"), shown(F.lit(0.0)).alias("on_black"))


@query(f"""WITH {PX}, s AS (SELECT y, x, v AS r, (v * 3) % 256 AS g, (v * 5) % 256 AS b FROM px)
SELECT y, x, CAST((r + 2 * g + b) // 4 AS INT) AS quarter, CAST((306 * r + 601 * g + 117 * b + 512) >> 10 AS INT) AS bt601, CAST(floor((299 * r + 587 * g + 114 * b) / 1000.0::DOUBLE + 0.5) AS INT) AS luma FROM s""")
def gray_variants(spark, sf_dir):
    s = raster(spark, sf_dir).select("y", "x", F.col("v").alias("r"), (F.col("v") * 3 % 256).alias("g"), (F.col("v") * 5 % 256).alias("b"))
    return s.select("y", "x", F.expr("CAST((r + 2 * g + b) DIV 4 AS INT)").alias("quarter"), F.shiftright(F.expr("306 * r + 601 * g + 117 * b + 512"), 10).cast("int").alias("bt601"), F.floor(F.expr("(299 * r + 587 * g + 114 * b) / 1000D") + 0.5).cast("int").alias("luma"))


# --- permutation and search --------------------------------------------------------------------------------------


def _line(spark, sf_dir):
    return ranked(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "i").select("i", F.col("l_quantity").cast("int").alias("v"))


@query(f"WITH {LINE} SELECT ((i - CAST(floor((sqrt(5) - 1) / 2 * n + 0.5) AS BIGINT) % n) % n + n) % n AS i, v FROM line, n")
def cyclic_shift(spark, sf_dir):
    line, n = _line(spark, sf_dir), table(spark, sf_dir, "lineitem").count()
    return ops.shifted(line, n, ops.shift(n, 1.0))


@query(f"WITH {LINE} SELECT i, v FROM line")
def cyclic_unshift(spark, sf_dir):
    line, n = _line(spark, sf_dir), table(spark, sf_dir, "lineitem").count()
    return ops.shifted(ops.shifted(line, n, ops.shift(n, 1.0)), n, -ops.shift(n, 1.0))


@query(f"WITH {PX} SELECT y, x, v FROM px")
def gilbert_scramble_roundtrip(spark, sf_dir):
    p = raster(spark, sf_dir)
    h = height(p)
    return ops.scramble(ops.scramble(p, 64, h), 64, h, back=True)


@query()
def gilbert_scramble(spark, sf_dir):
    p = raster(spark, sf_dir)
    return ops.scramble(p, 64, height(p))


@query(f"""WITH {PX}, h AS (SELECT max(y) + 1 AS h, (max(y) + 1) * 64 AS n FROM px),
c AS (SELECT s, r, row_number() OVER (ORDER BY s <> 10, s, r) AS visit FROM (SELECT unnest(range(21)) AS s), (SELECT unnest(range(1, 21)) AS r)),
o AS (SELECT CAST(floor(s / 10.0::DOUBLE * ((sqrt(5.0::DOUBLE) - 1) / 2) * n + 0.5) AS BIGINT) % n * r % n AS off, arg_min(s, visit) AS s, arg_min(r, visit) AS r FROM c, h GROUP BY 1),
line AS (SELECT y * 64 + x AS i, v FROM px), k AS (SELECT greatest(1, CAST(floor(sqrt(n // 12000)) AS BIGINT)) AS k FROM h),
l2 AS (SELECT i, v, (i + 1) % n AS i1, (i + 64) % n AS i2 FROM line, h),
st AS (SELECT a.i AS j, abs(a.v - b.v) AS dr, abs(a.v - c.v) AS dd FROM l2 a JOIN line b ON b.i = a.i1 JOIN line c ON c.i = a.i2),
g AS (SELECT y * 64 + x AS i, CAST(x < 63 AS INT) AS gr, CAST(y < h - 1 AS INT) AS gd FROM px, h, k WHERE x % k = 0 AND y % k = 0),
pr AS (SELECT off, s, r, gr, gd, (i + off) % n AS j FROM o, g, h),
sc AS (SELECT off, s, r, sum(dr * gr + dd * gd) AS total, sum(gr + gd) AS n FROM pr JOIN st USING (j) GROUP BY off, s, r)
SELECT s AS strength, r AS rounds, off AS "offset", round(total / n, 6) AS score FROM sc ORDER BY round(total / n, 6), abs(s - 10), r <> 1, r, s LIMIT 3""")
def rank_shift_parameters(spark, sf_dir):
    p = raster(spark, sf_dir)
    return ops.rank_shifts(p, height(p))


@query(f"""WITH {PX}, h AS (SELECT max(y) + 1 AS h, (max(y) + 1) * 64 AS n FROM px),
o AS (SELECT r, CAST(floor((sqrt(5.0::DOUBLE) - 1) / 2 * n + 0.5) AS BIGINT) % n * r % n AS off FROM h, (SELECT unnest(range(1, 21)) AS r)),
line AS (SELECT y * 64 + x AS i, v FROM px), k AS (SELECT greatest(1, CAST(floor(sqrt(n // 12000)) AS BIGINT)) AS k FROM h),
l2 AS (SELECT i, v, (i + 1) % n AS i1, (i + 64) % n AS i2 FROM line, h),
st AS (SELECT a.i AS j, abs(a.v - b.v) AS dr, abs(a.v - c.v) AS dd FROM l2 a JOIN line b ON b.i = a.i1 JOIN line c ON c.i = a.i2),
g AS (SELECT y * 64 + x AS i, CAST(x < 63 AS INT) AS gr, CAST(y < h - 1 AS INT) AS gd FROM px, h, k WHERE x % k = 0 AND y % k = 0),
sc AS (SELECT r, off, sum(dr * gr + dd * gd) AS total, sum(gr + gd) AS n FROM (SELECT r, off, gr, gd, (i + off) % n AS j FROM o, g, h) JOIN st USING (j) GROUP BY r, off)
SELECT CAST(r AS INT) AS rounds, off AS "offset", round(total / n, 6) AS score FROM sc""")
def rank_rounds(spark, sf_dir):
    p = raster(spark, sf_dir)
    return ops.rank_rounds(p, height(p))


SEED = "00112233445566778899aabbccddeeff"


@query(f"WITH {PX} SELECT y, x, v FROM px")
def chaotic_scramble_roundtrip(spark, sf_dir):
    how = {"key": 0.37, "columns": True}
    return permutation.permuted(permutation.permuted(raster(spark, sf_dir), 64, permutation.chaotic, **how), 64, permutation.chaotic, back=True, **how)


@query()
def chaotic_scramble_rows(spark, sf_dir):
    return permutation.permuted(raster(spark, sf_dir), 64, permutation.chaotic, key=0.37, columns=False)


@query(f"WITH {PX} SELECT y, x, v FROM px")
def block_scramble_roundtrip(spark, sf_dir):
    return permutation.permuted(permutation.permuted(raster(spark, sf_dir), 64, permutation.blocks, seed=SEED), 64, permutation.blocks, back=True, seed=SEED)


@query()
def block_scramble(spark, sf_dir):
    return permutation.permuted(raster(spark, sf_dir), 64, permutation.blocks, seed=SEED)


def _green_sql(green: str, others: str) -> str:
    return f"""WITH {PX}, c AS (SELECT y, x, v AS r0, (v * 3) % 256 AS g0, (v * 5) % 256 AS b0 FROM px),
f AS (SELECT *, r0 / 255.0::DOUBLE AS r, g0 / 255.0::DOUBLE AS g, b0 / 255.0::DOUBLE AS b FROM c), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM f),
l AS (SELECT *, (hi + lo) / 2 AS li, CASE WHEN hi = lo THEN 0::DOUBLE WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END * 100::DOUBLE AS s,
CASE WHEN hi = lo THEN 0::DOUBLE WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6 * 360 AS hue FROM m),
k AS (SELECT *, hue >= 75 AND hue <= 165 AND s > 8 AND li * 100 > 10 AND li * 100 < 90 AS hit, {green} AS gf, {others} AS rb FROM l)
SELECT y, x, CAST(CASE WHEN hit THEN least(255, floor(r0 * rb + 0.5)) ELSE r0 END AS INT) AS red, CAST(CASE WHEN hit THEN least(255, floor(g0 * gf + 0.5)) ELSE g0 END AS INT) AS green, CAST(CASE WHEN hit THEN least(255, floor(b0 * rb + 0.5)) ELSE b0 END AS INT) AS blue FROM k"""


def _greens(spark, sf_dir, enhance):
    v = F.col("v")
    return raster(spark, sf_dir).select("y", "x", *[c.alias(n) for c, n in zip(ops.green_adjusted(v, v * 3 % 256, v * 5 % 256, enhance), ("red", "green", "blue"))])


@query(_green_sql("1 + least(s, 70) / 100 * 0.6::DOUBLE", "greatest(0.7::DOUBLE, 1 - least(s, 70) / 100 * 0.3::DOUBLE)"))
def green_enhance(spark, sf_dir):
    return _greens(spark, sf_dir, True)


@query(_green_sql("greatest(0.5::DOUBLE, 1 - least(s, 80) / 100 * 0.5::DOUBLE)", "least(1.3::DOUBLE, 1 + least(s, 80) / 100 * 0.3::DOUBLE)"))
def green_reduce(spark, sf_dir):
    return _greens(spark, sf_dir, False)


# --- windows -----------------------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT y, x, CAST(sum(v) OVER w // count(v) OVER w AS INT) AS v FROM px WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def box_blur_rows(spark, sf_dir):
    return ops.box_mean(raster(spark, sf_dir), 2, "x", "y").select("y", "x", "v")


@query(f"""WITH {PX}, a AS (SELECT y, x, CAST(sum(v) OVER w // count(v) OVER w AS INT) AS v FROM px WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT y, x, CAST(sum(v) OVER w // count(v) OVER w AS INT) AS v FROM a WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def box_blur_2d(spark, sf_dir):
    return ops.box_mean(ops.box_mean(raster(spark, sf_dir), 3, "x", "y"), 3, "y", "x").select("y", "x", "v")


@query(f"WITH {PX} SELECT y // 8 AS ty, CAST(x // 8 AS INT) AS tx, CAST(sum(v) // count(v) AS INT) AS v FROM px GROUP BY 1, 2")
def mosaic(spark, sf_dir):
    return raster(spark, sf_dir).groupBy(F.expr("y DIV 8").alias("ty"), F.expr("CAST(x DIV 8 AS INT)").alias("tx")).agg(F.floor(F.sum("v") / F.count("v")).cast("int").alias("v"))


@query(f"WITH {PX}, d AS (SELECT v, lead(v) OVER (PARTITION BY y ORDER BY x) AS r, lead(v) OVER (PARTITION BY x ORDER BY y) AS b FROM px) SELECT CAST(sum(coalesce(abs(v - r), 0) + coalesce(abs(v - b), 0)) AS BIGINT) AS total, count(r) + count(b) AS pairs FROM d")
def continuity(spark, sf_dir):
    d = ops.own(ops.tiled(raster(spark, sf_dir), 1).withColumn("b", F.lead("v").over(ops.down()))).withColumn("r", F.lead("v").over(Window.partitionBy("y").orderBy("x")))
    zero = F.lit(0)
    return d.agg(F.sum(F.coalesce(F.abs(F.col("v") - F.col("r")), zero) + F.coalesce(F.abs(F.col("v") - F.col("b")), zero)).alias("total"), (F.count("r") + F.count("b")).alias("pairs"))


@query(f"WITH {PX}, a AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x) AS s FROM px) SELECT y, x, CAST(sum(s) OVER (PARTITION BY x ORDER BY y) AS BIGINT) AS s FROM a")
def integral_image(spark, sf_dir):
    a = raster(spark, sf_dir).withColumn("s", F.sum("v").over(Window.partitionBy("y").orderBy("x")))
    return ops.running_down(a, "s").select("y", "x", "s")


@query(f"""WITH {PX}, a AS (SELECT y, x, sum(v) OVER w AS s, count(v) OVER w AS n FROM px WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT y, x, CAST(least(211, greatest(96, sum(s) OVER w // sum(n) OVER w)) AS INT) AS threshold FROM a WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def box_threshold(spark, sf_dir):
    w = Window.partitionBy("y").orderBy("x").rowsBetween(-2, 2)
    a = raster(spark, sf_dir).select("y", "x", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    w = ops.down().rowsBetween(-2, 2)
    mean = F.least(F.lit(211), F.greatest(F.lit(96), F.floor(F.sum("s").over(w) / F.sum("n").over(w)))).cast("int")
    return ops.own(ops.tiled(a, 2).withColumn("threshold", mean)).select("y", "x", "threshold")


@query(f"""WITH {PX}, n AS (SELECT y, x, v, coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS b FROM px),
m AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY y ORDER BY x), 0) AS c FROM n),
p AS (SELECT *, CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS e FROM m),
r AS (SELECT y, unnest(range(5)) AS f, unnest([v, (v - a + 256) % 256, (v - b + 256) % 256, (v - (a + b) // 2 + 256) % 256, (v - e + 256) % 256]) AS q FROM p),
s AS (SELECT y, f, sum(least(q, 256 - q)) AS cost FROM r GROUP BY y, f)
SELECT y, CAST(f AS INT) AS filter, CAST(cost AS BIGINT) AS cost FROM s QUALIFY row_number() OVER (PARTITION BY y ORDER BY cost, f) = 1""")
def png_filter_choice(spark, sf_dir):
    return ops.predictor_costs(raster(spark, sf_dir)).groupBy("y").agg(F.min(F.struct("cost", "filter")).alias("b")).select("y", "b.filter", "b.cost")


@query(f"""WITH {PX}, z AS (SELECT y, x, CASE WHEN v >= 120 THEN v END AS v FROM px)
SELECT y, x, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM z""")
def next_valid_fill(spark, sf_dir):
    z = raster(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 120, F.col("v")))
    w = Window.partitionBy("y").orderBy("x")
    after, before = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    return z.select("y", "x", F.coalesce(F.first("v", True).over(after), F.last("v", True).over(before)).alias("v"))


def _kept_folder(spark) -> None:
    """Lineage is cut in the folder that spark.checkpoint.dir names; without one (and none set by tests) it can't be."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


@query(f"""WITH RECURSIVE {PX}, m AS (SELECT y, x, y * 64 + x AS i FROM px WHERE v > 150),
e AS ({" UNION ALL ".join(f"SELECT a.i, b.i AS j FROM m a JOIN m b ON b.i = a.i + {d} AND b.x - a.x = {dx}" for d, dx in ((1, 1), (-1, -1), (64, 0), (-64, 0)))}),
r AS (SELECT i AS root, i FROM m UNION SELECT r.root, e.j FROM r JOIN e ON e.i = r.i)
SELECT m.y, m.x, min(r.root) AS label FROM r JOIN m ON m.i = r.i GROUP BY m.y, m.x""")
def grid_components(spark, sf_dir):
    _kept_folder(spark)
    return ops.components(raster(spark, sf_dir).where("v > 150"))


@query(f"WITH {PX}, c AS (SELECT y // 8 AS ty, CAST(x // 8 AS INT) AS tx, CAST(sum(v) AS BIGINT) AS cost FROM px GROUP BY 1, 2) SELECT ty, tx, cost FROM c ORDER BY cost, ty, tx LIMIT 1")
def placement_argmin(spark, sf_dir):
    c = raster(spark, sf_dir).groupBy(F.expr("y DIV 8").alias("ty"), F.expr("CAST(x DIV 8 AS INT)").alias("tx")).agg(F.sum("v").alias("cost"))
    return c.agg(F.min(F.struct("cost", "ty", "tx")).alias("m")).select("m.ty", "m.tx", "m.cost")


# --- order, sets, look-ups ---------------------------------------------------------------------------------------


@query("WITH s AS (SELECT doc_id, source, doc_id * 10 AS a, doc_id * 10 + 10 - CAST(doc_id % 7 = 0 AS INT) AS b FROM documents) SELECT doc_id, a = lag(b, 1, a) OVER (PARTITION BY source ORDER BY doc_id) AS ok FROM s")
def contiguity_check(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") * 10).alias("a"), (F.col("doc_id") * 10 + 10 - (F.col("doc_id") % 7 == 0).cast("int")).alias("b"))
    # a source may hold any share of the table: rows are numbered by ranges and meet the one before by number
    n = ranked(s, "doc_id", [], "i", group="source")
    before = n.select("source", (F.col("i") + 1).alias("i"), F.col("b").alias("before"))
    return n.join(before, ["source", "i"], "left").select("doc_id", (F.col("a") == F.coalesce("before", "a")).alias("ok"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedupe_first_seen(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


#: CRC-32 over a text's bytes: what a byte does to each low byte of the sum, then byte after byte.
CRC_SQL = """t AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT doc_id, list_transform(regexp_extract_all('74455874' || hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents)"""


@query(f"WITH {CRC_SQL} SELECT doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS crc FROM b, t")
def crc_chunk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.concat(F.lit(b"tEXt"), F.col("text").cast("binary"))).alias("crc"))


def _kept(spark):
    return spark.createDataFrame([(t,) for t in LIVE_TYPES], "event_type string")


@query(f"SELECT event_id, event_type FROM events WHERE event_type IN {LIVE_TYPES}")
def allowlist_chunks(spark, sf_dir):
    return table(spark, sf_dir, "events").join(F.broadcast(_kept(spark)), "event_type", "left_semi").select("event_id", "event_type")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN {LIVE_TYPES} GROUP BY event_type")
def leftover_chunks(spark, sf_dir):
    return table(spark, sf_dir, "events").join(F.broadcast(_kept(spark)), "event_type", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, n_chars, quality, l.doc_id IS NOT NULL AND quality = 1 AS accepted FROM documents d JOIN labels l USING (doc_id)")
def manifest_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "n_chars", "quality", (F.col("quality") == 1).alias("accepted"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT source, bool_and(quality IS NOT NULL) AS complete, count(quality) AS verified, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def package_complete(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.bool_and(F.col("quality").isNotNull()).alias("complete"), F.count("quality").alias("verified"), F.count("*").alias("files"))


@query("SELECT doc_id, coalesce(quality, CASE WHEN lang = 'en' THEN 2 END, 3) AS cover FROM documents LEFT JOIN labels USING (doc_id)")
def cover_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.when(F.col("lang") == "en", 2), F.lit(3)).alias("cover"))


@query("SELECT event_type, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS files, least(999, count(*) FILTER (WHERE value > 50) * 1000 // count(*)) AS per_mille FROM events GROUP BY event_type")
def progress_overall(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.floor(F.col("value") * 100)).alias("bytes"), F.count("*").alias("files"), F.least(F.lit(999), F.floor(F.count_if(F.col("value") > 50) * 1000 / F.count("*"))).alias("per_mille"))


@query("SELECT doc_id, source || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS name FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def unique_output_names(spark, sf_dir):
    n = ranked(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", [], "n", group="source").withColumn("n", F.col("n") + 1)
    return n.select("doc_id", F.concat("source", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))).alias("name"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^/@\s?#]+([/?#]|$)') AND octet_length(encode(url)) <= 1100 AS ok FROM pages")
def website_predicate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.col("url").rlike(r"^https?://[^/@\s?#]+([/?#]|$)") & (F.octet_length("url") <= 1100)).alias("ok"))


@query(r"SELECT conv_id, turn, octet_length(encode(text)) <= 1100 AND regexp_matches(text, '[^ \t\r\n]') AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS ok FROM conversations")
def payload_predicate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.octet_length(t) <= 1100) & t.rlike(r"[^ \t\r\n]") & ~t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).alias("ok"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^a-zA-Z0-9_])(the|tree|vest)(s|es)?([^a-zA-Z0-9_]|$)') AS found FROM documents")
def caption_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(^|[^a-zA-Z0-9_])(the|tree|vest)(s|es)?([^a-zA-Z0-9_]|$)").alias("found"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[\s_-]+', '', 'g') AS key FROM part")
def key_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), r"[\s_-]+", "").alias("key"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("WITH RECURSIVE up AS (SELECT max(event_id) AS id FROM events UNION ALL SELECT id // 2 FROM up WHERE id > 0) SELECT e.event_id, e.event_type FROM up JOIN events e ON e.event_id = up.id")
def upstream_closure(spark, sf_dir):
    # no view is registered: two threads may ask for different tables
    return spark.sql("WITH RECURSIVE up(id) AS (SELECT max(event_id) FROM {events} UNION ALL SELECT id DIV 2 FROM up WHERE id > 0) SELECT e.event_id, e.event_type FROM up JOIN {events} e ON e.event_id = up.id", events=table(spark, sf_dir, "events"))


@query("SELECT a.l_orderkey, a.l_linenumber, count(b.l_linenumber) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_quantity - b.l_quantity) <= 10 GROUP BY ALL")
def neighbour_rectangles(spark, sf_dir):
    """Rows near in value inside a group: a sliding range frame instead of a self-join."""
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity").rangeBetween(-10, 10)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    near = by_key(line, line, "l_orderkey").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"))
    return near.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"))


@query("""WITH m AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS large, s_suppkey % 5 = 0 AS saving, greatest(0, s_acctbal) / 300 AS total, greatest(0, s_acctbal) / 400 AS free FROM supplier),
q AS (SELECT *, total >= 16 AND free >= 12 AND NOT saving AS quality FROM m)
SELECT s_suppkey, CASE WHEN quality THEN 1024 WHEN large OR total >= 7 THEN 768 ELSE 512 END AS edge, CASE WHEN quality THEN 40 WHEN total >= 8 THEN 32 ELSE 24 END AS steps, total < 16 OR free < 12 OR saving AS offload, free < 5 AND total > 0 AS sequential FROM q""")
def hardware_policy(spark, sf_dir):
    """Picture size, steps and memory saving for a machine's total and free memory in GB, a model family and a preference."""
    b = F.greatest(F.lit(0), F.col("s_acctbal"))
    large, saving, total, free = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 5 == 0, b / 300, b / 400
    quality = (total >= 16) & (free >= 12) & ~saving
    edge = F.when(quality, 1024).when(large | (total >= 7), 768).otherwise(512)
    steps = F.when(quality, 40).when(total >= 8, 32).otherwise(24)
    return table(spark, sf_dir, "supplier").select("s_suppkey", edge.alias("edge"), steps.alias("steps"), ((total < 16) | (free < 12) | saving).alias("offload"), ((free < 5) & (total > 0)).alias("sequential"))


@query("""WITH m AS (SELECT p_partkey, p_size AS module, p_size * 64 AS width, (p_partkey % 3 + 1) * p_size * 32 AS height, p_size * (p_partkey % 7) AS place FROM part)
SELECT p_partkey, (SELECT min(d) FROM (SELECT unnest(range(1, 51)) AS d) WHERE d >= greatest(1, ceil(greatest(width, height) / 512)) AND d <= module AND module % d = 0 AND width % d = 0 AND height % d = 0 AND place % d = 0 AND width // d % 8 = 0 AND height // d % 8 = 0) AS divisor FROM m""")
def latent_divisor(spark, sf_dir):
    """The least reduction to 512 pixels that keeps a code's grid whole, and each side a multiple of 8; null if none."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    m = table(spark, sf_dir, "part").select("p_partkey", size.alias("module"), (size * 64).alias("width"), ((key % 3 + 1) * size * 32).alias("height"), (size * (key % 7)).alias("at"))
    whole = lambda d: (F.col("module") % d == 0) & (F.col("width") % d == 0) & (F.col("height") % d == 0) & (F.col("at") % d == 0)
    eighths = lambda d: F.expr("width") % (d * 8) == 0
    least = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / 512))
    fits = F.filter(F.sequence(F.lit(1).cast("long"), F.col("module")), lambda d: (d >= least) & whole(d) & eighths(d) & (F.col("height") % (d * 8) == 0))
    return m.select("p_partkey", F.array_min(fits).alias("divisor"))


# --- containers and events ---------------------------------------------------------------------------------------


@query("SELECT doc_id, text FROM documents")
def png_roundtrip(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", containers.to_png("text").alias("png")).select("doc_id", containers.png_chunks("png").alias("c"))
    return chunks.select("doc_id", containers.itxt_text(F.filter("c", lambda c: (c["type"] == "iTXt") & c["crc_ok"])[0]["data"]).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN coalesce(lang, '') || ':' || n_chars END AS record FROM documents")
def trailer_roundtrip(spark, sf_dir):
    """Records behind texts; each fourth file has lost its last byte."""
    whole = containers.with_tail(F.col("text").cast("binary"), F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.col("n_chars").cast("string")))
    kept = table(spark, sf_dir, "documents").select("doc_id", whole.alias("c")).select("doc_id", F.expr("substring(c, 1, octet_length(c) - IF(doc_id % 4 = 1, 1, 0))").alias("c"))
    return kept.select("doc_id", containers.tail_of(F.col("c")).alias("record"))


@query("SELECT user_id, event_id, event_type, n FROM (SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def events_latest_wins(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"))


@query("SELECT doc_id, doc_id % 5 IN (0, 3) AS ok FROM documents")
def mp4_check(spark, sf_dir):
    """Films whole, without their index, a byte short, with a size of 64 bits, and with too short a head."""
    data, empty, kind = F.col("text").cast("binary"), F.lit(b""), F.col("doc_id") % 5
    head = F.when(kind == 4, validators.box("ftyp", F.lit(b"isom"))).otherwise(validators.box("ftyp", F.lit(b"isom\0\0\2\0")))
    wide = F.concat(F.lit(b"\0\0\0\1mdat"), F.unhex(F.lpad(F.hex(F.octet_length(data) + 16), 16, "0")), data)
    whole = F.concat(head, F.when(kind == 1, empty).otherwise(validators.box("moov", empty)), F.when(kind == 3, wide).otherwise(validators.box("mdat", data)))
    films = table(spark, sf_dir, "documents").select("doc_id", whole.alias("c")).select("doc_id", F.expr("substring(c, 1, octet_length(c) - IF(doc_id % 5 = 2, 1, 0))").alias("c"))
    return films.select("doc_id", validators.valid_mp4("c").alias("ok"))


def _damaged(spark, sf_dir, make, check, fourth):
    """Files made from all texts: by number whole, a byte short, with another first byte, with a byte behind, or with the
    fourth kind of damage."""
    made = table(spark, sf_dir, "documents").select("doc_id", make("text").alias("c"))
    kind, n = F.col("doc_id") % 5, F.octet_length("c")
    short, headless, longer = F.substring("c", F.lit(1), n - 1), F.concat(F.lit(b"x"), F.substring("c", F.lit(2), n)), F.concat("c", F.lit(b"x"))
    file = F.when(kind == 1, short).when(kind == 2, headless).when(kind == 3, longer).when(kind == 4, fourth(F.col("c"), n)).otherwise(F.col("c"))
    return made.select("doc_id", check(file).alias("ok"))


@query("SELECT doc_id, doc_id % 5 = 0 AS ok FROM documents")
def zip_check(spark, sf_dir):
    """The fourth kind: one entry more is said to be there."""
    return _damaged(spark, sf_dir, validators.to_zip, validators.valid_zip, lambda c, n: F.concat(F.substring(c, F.lit(1), n - 14), F.lit(b"\2\0\2\0"), F.substring(c, n - 9, F.lit(10))))


@query("SELECT doc_id, doc_id % 5 IN (0, 3, 4) AS ok FROM documents")
def seven_zip_check(spark, sf_dir):
    """A byte behind is no damage, nor is the fourth kind: another version."""
    return _damaged(spark, sf_dir, validators.to_7z, validators.valid_7z, lambda c, n: F.concat(F.substring(c, F.lit(1), F.lit(6)), F.lit(b"\x09\x09"), F.substring(c, F.lit(9), n)))


@query("SELECT doc_id, doc_id % 5 = 0 AS ok FROM documents")
def safetensors_check(spark, sf_dir):
    """The fourth kind: a header that doesn't begin as an object."""
    return _damaged(spark, sf_dir, validators.to_safetensors, validators.valid_safetensors, lambda c, n: F.concat(F.substring(c, F.lit(1), F.lit(8)), F.lit(b"["), F.substring(c, F.lit(10), n)))


def _hex_sql(x: str) -> str:
    return f"lower(hex(encode({x})))"


EXIF_SQL = "'49492a0008000000010012010300010000000' || turned || '00000000000000'"
TURNED = "CAST(doc_id % 9 AS INT)"


def _exif(turned):
    """An EXIF block with an orientation, in the order of bytes that an odd or even number says."""
    hexed = F.lpad(F.hex(turned), 2, "0")
    little = F.concat(F.lit("49492A000800000001001201030001000000"), hexed, F.lit("00000000000000"))
    big = F.concat(F.lit("4D4D002A0000000800010112000300000001"), F.lit("00"), hexed, F.lit("000000000000"))
    return F.unhex(F.when(F.col("doc_id") % 2 == 0, little).otherwise(big))


@query(f"""SELECT doc_id, '47494638396101000100000000' || CASE WHEN doc_id % 2 = 1 THEN '21ff0b' || {_hex_sql("'NETSCAPE2.0'")} || '0301000000' ELSE '' END || '21f904' || lower(printf('%08x', CAST(doc_id AS BIGINT))) || '00' || '2c0000000001000100000210' || md5(text) || '003b' AS cleaned FROM documents""")
def gif_clean(spark, sf_dir):
    """Of a loop mark, a comment, an application's data, a delay and a picture, comment and data go."""
    digest = F.md5("text")
    loop = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(b"\x21\xff\x0bNETSCAPE2.0"), F.unhex(F.lit("0301000000")))).otherwise(F.lit(b""))
    note, app = F.concat(F.lit(b"\x21\xfe\x20"), digest.cast("binary"), F.lit(b"\0")), F.concat(F.lit(b"\x21\xff\x0bXMP DataXMP\x20"), digest.cast("binary"), F.lit(b"\0"))
    delay = F.concat(F.lit(b"\x21\xf9\x04"), F.unhex(F.lpad(F.hex("doc_id"), 8, "0")), F.lit(b"\0"))
    gif = F.concat(F.lit(b"GIF89a\1\0\1\0\0\0\0"), loop, note, app, delay, F.lit(b"\x2c\0\0\0\0\1\0\1\0\0\x02\x10"), F.unhex(digest), F.lit(b"\0\x3b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(validators.gif_without_notes(gif))).alias("cleaned"))


@query(f"""SELECT doc_id, 'ffd8' || CASE WHEN doc_id % 3 <> 0 THEN 'ffe000104a46494600010100000100010000' ELSE '' END || CASE WHEN turned > '1' AND turned < '9' THEN 'ffe10022457869660000' || {EXIF_SQL} ELSE '' END || 'ffdb0004' || left(md5(text), 4) || 'ffda0002' || {_hex_sql("md5(text)")} || 'ffd9' AS cleaned FROM (SELECT doc_id, text, CAST({TURNED} AS VARCHAR) AS turned FROM documents)""")
def jpeg_clean(spark, sf_dir):
    """Of a head, a comment, an orientation, an application's data, a table and a scan, comment and data go; an orientation
    that turns nothing goes too."""
    digest = F.md5("text")
    head = F.when(F.col("doc_id") % 3 != 0, F.unhex(F.lit("ffe000104a46494600010100000100010000"))).otherwise(F.lit(b""))
    exif = F.concat(F.lit(b"\xff\xe1\x00\x22Exif\0\0"), _exif(F.col("doc_id") % 9))
    jpeg = F.concat(F.lit(b"\xff\xd8"), head, F.lit(b"\xff\xfe\x00\x22"), digest.cast("binary"), exif, F.lit(b"\xff\xed\x00\x04zz"), F.lit(b"\xff\xdb\x00\x04"), F.unhex(F.left(digest, F.lit(4))), F.lit(b"\xff\xda\x00\x02"), digest.cast("binary"), F.lit(b"\xff\xd9"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(validators.jpeg_without_notes(jpeg))).alias("cleaned"))


@query(r"""SELECT doc_id, CASE WHEN k > 0 THEN rtrim(left(t, greatest(k - 2, 0)), x) ELSE rtrim(t, x) END AS prompt, CASE WHEN k > 0 THEN ltrim(substr(t, k + 16), x) || chr(10) || 'Negative prompt: ' || coalesce(lang, '') ELSE coalesce(lang, '') END AS negative, '18446744073709551615' AS seed, source || ', Size: 1' AS model
FROM (SELECT *, position(chr(10) || 'Negative prompt:' IN chr(10) || t) AS k FROM (SELECT doc_id, lang, source, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' AS x, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents))""")
def webui_parameters(spark, sf_dir):
    """Any text as a prompt with its parameters; blanks at its end are not kept."""
    made = F.concat(F.coalesce("text", F.lit("")), F.lit("\nNegative prompt: "), F.coalesce("lang", F.lit("")), F.lit("\nSteps: 20, Seed: 18446744073709551615, Model: \""), "source", F.lit(", Size: 1\""))
    p = table(spark, sf_dir, "documents").select("doc_id", prompts.parameters(made).alias("p"))
    return p.select("doc_id", "p.prompt", "p.negative", F.col("p.fields")["Seed"].alias("seed"), F.col("p.fields")["Model"].alias("model"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(city|cities|street|building|architecture)(s|es)?([^\p{L}\p{N}_]|$)') THEN 'coherent street architecture, varied windows, layered balconies, reflected daylight' WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(forest|tree|garden|plant)(s|es)?([^\p{L}\p{N}_]|$)') AND NOT regexp_matches(t, '(^|[^\p{L}\p{N}_])(room|window|indoor)(s|es)?([^\p{L}\p{N}_]|$)') THEN 'overlapping leaves and branches, varied foliage, dappled daylight' WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(sea|beach|ocean|water)(s|es)?([^\p{L}\p{N}_]|$)') THEN 'coastal scenery, rippling water, rocks and soft reflected daylight' WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(mountain|landscape|hill)(s|es)?([^\p{L}\p{N}_]|$)') THEN 'layered landscape, textured rocks and foliage, natural depth and soft shadows' ELSE 'quiet room, wooden window frames, a few leafy plants, soft side lighting' END || ', ' ||
CASE WHEN regexp_matches(t, 'anime|cartoon|drawing|illustration') THEN 'illustration, clean coherent linework, matching original shading' WHEN regexp_matches(t, 'photo') THEN 'photograph, realistic surface detail, natural lighting' ELSE 'matching the original visual style, consistent colors and lighting' END AS prompt FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def scene_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.scene_prompt(F.col("text")).alias("prompt"))


# --- two pictures in one -----------------------------------------------------------------------------------------

SIDES = "s AS (SELECT y, x, v AS lr, (v * 3) % 256 AS lg, (v * 5) % 256 AS lb, (v * 7) % 256 AS dr, (v * 11) % 256 AS dg, (v * 13) % 256 AS db FROM px)"


def _two(spark, sf_dir):
    """The raster as a light and a dark picture in colour."""
    times = lambda k: (F.col("v") * k % 256)
    p = raster(spark, sf_dir)
    return p, [times(k) for k in (1, 3, 5)], [times(k) for k in (7, 11, 13)]


def _byte_sql(x: str) -> str:
    return f"CAST(least(255, greatest(0, floor({x} + 0.5))) AS INT)"


def _stored_sql(c: str) -> str:
    return f"CASE WHEN a = 0 THEN 0 ELSE {_byte_sql(f'least(a::DOUBLE, greatest(0, (w{c} + b{c} - 255 + a) / 2)) * 255 / a')} END"


@query(f"""WITH {PX}, {SIDES}, u AS (SELECT *, (299 * lr + 587 * lg + 114 * lb) / 1000.0::DOUBLE AS ly, (299 * dr + 587 * dg + 114 * db) / 1000.0::DOUBLE AS dy FROM s),
k AS (SELECT y, x, {", ".join(f"127.5 + (ly + (l{c} - ly) * 0.75::DOUBLE) * 0.5::DOUBLE AS w{c}, (dy + (d{c} - dy) * 0.75::DOUBLE) * 0.5::DOUBLE AS b{c}" for c in "rgb")} FROM u),
t AS (SELECT *, list_sort([{", ".join(f"abs(w{c} + b{c} - 255)" for c in "rgb")}]) AS t, {" + ".join(f"CASE WHEN w{c} + b{c} >= 255 THEN 2 * b{c} ELSE 2 * (255 - w{c}) END" for c in "rgb")} AS q FROM k),
o AS (SELECT *, {_byte_sql("CASE WHEN q / 6 <= t[1] THEN q / 6 WHEN (q - t[1]) / 5 <= t[2] THEN (q - t[1]) / 5 WHEN (q - t[1] - t[2]) / 4 <= t[3] THEN (q - t[1] - t[2]) / 4 ELSE (q - t[1] - t[2] - t[3]) / 3 END")} AS a FROM t)
SELECT y, x, a AS alpha, {_stored_sql("r")} AS red, {_stored_sql("g")} AS green, {_stored_sql("b")} AS blue FROM o""")
def reveal_pixels(spark, sf_dir):
    p, light, dark = _two(spark, sf_dir)
    return reveal.reveal(p, light, dark, 0.75, "y", "x")


@query()
def reveal_source_colours(spark, sf_dir):
    p, light, dark = _two(spark, sf_dir)
    lit = lambda v: F.lit(float(v))
    return reveal.source_coloured(p, light, dark, (lit(20), lit(240)), lit(0.8), lit(0.55), reveal.chroma_budget(lit(220), lit(80)), "y", "x")


@query(f"""WITH {PX}, {SIDES}, u AS (SELECT *, (299 * lr + 587 * lg + 114 * lb) / 1000.0::DOUBLE AS ly, (299 * dr + 587 * dg + 114 * db) / 1000.0::DOUBLE AS dy FROM s),
m AS (SELECT *, 190 + 60 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (ly - 20) / 220)) AS wt, 4 + 161 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (dy - 10) / 235)) AS bt FROM u),
f AS (SELECT wt, bt, unnest([lr - dr, lg - dg, lb - db]) AS d, unnest([(lr - ly) * 0.5::DOUBLE, (lg - ly) * 0.5::DOUBLE, (lb - ly) * 0.5::DOUBLE]) AS wc, unnest([(dr - dy) * 0.5::DOUBLE, (dg - dy) * 0.5::DOUBLE, (db - dy) * 0.5::DOUBLE]) AS bc, greatest(lr - dr, lg - dg, lb - db) - least(lr - dr, lg - dg, lb - db) AS apart FROM m)
SELECT CAST(round(min(least(CASE WHEN apart > 0 THEN 4.0::DOUBLE / apart ELSE 1 END, CASE WHEN wc > 0 THEN (255 - wt) / wc WHEN wc < 0 THEN -wt / wc ELSE 1 END, CASE WHEN bc > 0 THEN (255 - bt) / bc WHEN bc < 0 THEN -bt / bc ELSE 1 END)) * 1000000000) AS BIGINT) AS "limit" FROM f""")
def colour_limit(spark, sf_dir):
    p, light, dark = _two(spark, sf_dir)
    lit = lambda v: F.lit(float(v))
    light_tone = reveal.tone(reveal.luma(light), lit(20), lit(240), lit(190), lit(250))
    dark_tone = reveal.tone(reveal.luma(dark), lit(10), lit(245), lit(4), lit(165))
    return p.agg(F.round(F.min(reveal.colour_limit(light, dark, light_tone, dark_tone)) * 1e9).cast("long").alias("limit"))


@query(f"""WITH {PX}, {SIDES}, m AS (SELECT y, x, (v * 7 + x) % 2 AS ink, least(255, greatest(181, floor(190 + 60 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((299 * lr + 587 * lg + 114 * lb) / 1000.0::DOUBLE - 20) / 220)) + 0.5))) AS w FROM s JOIN px USING (y, x)),
a AS (SELECT y, x, CASE WHEN ink = 1 THEN 16 ELSE 112 END AS b, CAST(floor(255 * (1 - (w - CASE WHEN ink = 1 THEN 16 ELSE 112 END) / 250.0::DOUBLE) + 0.5) AS INT) AS alpha FROM m)
SELECT y, x, alpha, CASE WHEN alpha = 0 THEN 0 ELSE CAST(floor(b * 255.0::DOUBLE / alpha + 0.5) AS INT) END AS gray FROM a""")
def code_modules(spark, sf_dir):
    p, light, _ = _two(spark, sf_dir)
    a, gray = reveal.code_module(light, (F.col("v") * 7 + F.col("x")) % 2 == 1, F.lit(20.0), F.lit(240.0), F.lit(190.0))
    return p.select("y", "x", a.alias("alpha"), gray.alias("gray"))


def _constrained_sql(c: str) -> str:
    return f"CAST(CASE WHEN ink AND u > 90 THEN round_even(l{c} * (90 / greatest(1, u)), 0) WHEN NOT ink AND u < 170 THEN round_even(l{c} + (255 - l{c}) * ((170 - u) / greatest(1, 255 - u)), 0) ELSE l{c} END AS INT)"


@query(f"""WITH {PX}, {SIDES}, m AS (SELECT *, dr % 2 = 1 AS ink, 0.299::DOUBLE * lr + 0.587::DOUBLE * lg + 0.114::DOUBLE * lb AS u FROM s)
SELECT y, x, {_constrained_sql("r")} AS red, {_constrained_sql("g")} AS green, {_constrained_sql("b")} AS blue FROM m""")
def code_constraint(spark, sf_dir):
    p, light, dark = _two(spark, sf_dir)
    out = qr.constrained(light, dark[0] % 2 == 1, F.lit(90.0), F.lit(170.0))
    return p.select("y", "x", *[c.alias(n) for c, n in zip(out, ("red", "green", "blue"))])


@query("SELECT page_id, trim(url) AS url FROM pages WHERE octet_length(encode(url)) <= 1100 AND trim(url) <> ''")
def qr_roundtrip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where((F.octet_length("url") <= 1100) & (F.trim("url") != ""))
    return pages.select("page_id", qr.symbol(F.trim("url")).alias("s")).select("page_id", qr.symbol_text("s.side", "s.modules").alias("url"))


# --- regions -----------------------------------------------------------------------------------------------------

IMG = "img AS (SELECT y // 64 AS image, y % 64 AS y, x, v FROM px)"
BLK = """hs AS (SELECT image, max(y) + 1 AS h FROM img GROUP BY image HAVING max(y) + 1 >= 40),
nb AS (SELECT image, h, unnest(range((h + 7) // 8)) AS gy FROM hs),
blk AS (SELECT n.image, n.gy, i.x // 8 AS gx, min(v) AS low, max(v) AS high, sum(v) // 64 AS mean FROM nb n JOIN img i ON i.image = n.image AND i.y >= least(n.gy * 8, h - 8) AND i.y < least(n.gy * 8, h - 8) + 8 GROUP BY ALL)"""


def _images(spark, sf_dir):
    """The raster cut into images of 64 x 64."""
    return raster(spark, sf_dir).select(F.floor(F.col("y") / 64).alias("image"), (F.col("y") % 64).cast("int").alias("y"), "x", "v")


@query(f"WITH {PX}, {IMG}, {BLK} SELECT image, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, low, high, CAST(mean AS INT) AS mean FROM blk")
def block_stats(spark, sf_dir):
    return regions.block_stats(_images(spark, sf_dir))


@query(f"""WITH {PX}, {IMG}, {BLK}, m AS (SELECT image, gy, gx, CASE WHEN high - low > 24 THEN (high + low) // 2 ELSE 0 END AS m FROM blk),
d AS (SELECT image, max(gy) + 1 AS bh, max(gx) + 1 AS bw FROM m GROUP BY image),
t AS (SELECT a.image, a.gy, a.gx, (a.m * 2 + sum(b.m)) // nullif((a.m > 0)::INT * 2 + sum((b.m > 0)::INT), 0) AS t FROM m a JOIN d USING (image) JOIN m b ON b.image = a.image AND abs(b.gy - least(bh - 3, greatest(2, a.gy))) <= 2 AND abs(b.gx - least(bw - 3, greatest(2, a.gx))) <= 2 GROUP BY a.image, a.gy, a.gx, a.m)
SELECT image, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST(coalesce(first_value(nullif(t, 0) IGNORE NULLS) OVER (PARTITION BY image ORDER BY gy, gx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(nullif(t, 0) IGNORE NULLS) OVER (PARTITION BY image ORDER BY gy, gx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INT) AS threshold FROM t""")
def contrast_thresholds(spark, sf_dir):
    return regions.contrast_thresholds(regions.block_stats(_images(spark, sf_dir)))


@query(f"""WITH RECURSIVE {PX}, {IMG}, {BLK}, b AS (SELECT image, gy, gx, low, high, mean, gy * 8 + gx AS i FROM blk),
r AS (SELECT image, i, [CASE WHEN high - low > 24 THEN mean ELSE low // 2 END] AS o FROM b WHERE i = 0
UNION ALL SELECT b.image, b.i, list_append(o, CASE WHEN high - low > 24 THEN mean WHEN gx > 0 AND gy > 0 AND low < (o[b.i - 7] + 2 * o[b.i] + o[b.i - 8]) // 4 THEN (o[b.i - 7] + 2 * o[b.i] + o[b.i - 8]) // 4 ELSE low // 2 END) FROM r JOIN b ON b.image = r.image AND b.i = r.i + 1),
p AS (SELECT image, gy, gx, o[-1] AS point FROM r JOIN b USING (image, i)), d AS (SELECT image, max(gy) + 1 AS bh, max(gx) + 1 AS bw FROM p GROUP BY image)
SELECT a.image, CAST(a.gy AS INT) AS gy, CAST(a.gx AS INT) AS gx, CAST(sum(b.point) // 25 AS INT) AS threshold FROM p a JOIN d USING (image) JOIN p b ON b.image = a.image AND abs(b.gy - least(bh - 3, greatest(2, a.gy))) <= 2 AND abs(b.gx - least(bw - 3, greatest(2, a.gx))) <= 2 GROUP BY a.image, a.gy, a.gx""")
def mean_thresholds(spark, sf_dir):
    return regions.mean_thresholds(regions.block_stats(_images(spark, sf_dir)))


@query(f"WITH {PX}, {IMG} SELECT a.image, a.y, a.x, max(b.v) AS v FROM img a JOIN img b ON a.image = b.image AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL")
def grown(spark, sf_dir):
    return regions.neighbourhood(_images(spark, sf_dir), 2, grow=True)


@query(f"WITH {PX}, {IMG} SELECT a.image, a.y, a.x, min(b.v) AS v FROM img a JOIN img b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def shrunk(spark, sf_dir):
    return regions.neighbourhood(_images(spark, sf_dir), 1, grow=False)


_OVER = "(greatest(0, least(q.r, box.r) - greatest(q.l, box.l)) * greatest(0, least(q.d, box.d) - greatest(q.t, box.t)))"


@query(f"""WITH RECURSIVE d AS (SELECT l_orderkey AS image, ('0x' || substr(md5(l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity::INT), 1, 15))::BIGINT AS box_id, l_extendedprice AS score, l_quantity::INT AS "left", (l_linenumber * 3)::INT AS top FROM lineitem),
b AS (SELECT *, {{'l': "left", 't': top, 'r': "left" + 20, 'd': top + 20}} AS box, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS i FROM d),
r AS (SELECT image, 0::BIGINT AS i, [] AS kept, false AS stays FROM b GROUP BY image
UNION ALL SELECT image, i, CASE WHEN ok THEN list_append(kept, box) ELSE kept END, ok FROM (SELECT b.image, b.i, kept, box, len(list_filter(kept, lambda q: {_OVER}::DOUBLE / greatest(1, 800 - {_OVER}) > 0.45)) = 0 AS ok FROM r JOIN b ON b.image = r.image AND b.i = r.i + 1))
SELECT image, box_id, score, "left", top, "left" + 20 AS "right", top + 20 AS bottom FROM r JOIN b USING (image, i) WHERE stays""".replace("[] AS kept", "CAST([] AS STRUCT(l INT, t INT, r INT, d INT)[]) AS kept"))
def box_suppression(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    line = table(spark, sf_dir, "lineitem")
    name = F.md5(F.concat_ws("/", *[c.cast("string") for c in (n, F.col("l_partkey"), F.col("l_suppkey"), q)]).cast("binary"))
    boxes = line.select(F.col("l_orderkey").alias("image"), F.conv(F.substring(name, 1, 15), 16, 10).cast("long").alias("box_id"), F.col("l_extendedprice").alias("score"), q.alias("left"), (n * 3).alias("top"), (q + 20).alias("right"), (n * 3 + 20).alias("bottom"))
    return regions.suppressed(boxes, "image")


@query("""WITH r AS (SELECT l_suppkey AS image, l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_tax * 500 AS y, 4 + l_discount * 20 AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY 4 + l_discount * 20 DESC, l_orderkey * 8 + l_linenumber) AS n FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)),
t AS (SELECT p.image, p.id AS p, q.id AS q, s.id AS s, q.x - p.x AS xu, q.y - p.y AS yu, s.x - p.x AS xv, s.y - p.y AS yv, (p.d + q.d + s.d) / 3 AS mean, greatest(p.d, q.d, s.d) / least(p.d, q.d, s.d) AS uneven
FROM r p JOIN r q ON p.image = q.image AND p.n <> q.n JOIN r s ON s.image = p.image AND s.n <> p.n AND CASE WHEN p.n BETWEEN least(q.n, s.n) AND greatest(q.n, s.n) THEN q.n > s.n ELSE q.n < s.n END),
l AS (SELECT *, sqrt(xu * xu + yu * yu) AS lu, sqrt(xv * xv + yv * yv) AS lv, xu * yv - yu * xv AS z FROM t)
SELECT image, p AS corner, least(q, s) AS low, greatest(q, s) AS high FROM l WHERE lu >= 1.8 * mean AND lv >= 1.8 * mean AND abs(xu * xv + yu * yv) <= 0.12 * lu * lv AND lu / lv BETWEEN 0.85 AND 1.18 AND uneven <= 1.25""")
def ring_corners(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount")])
    rings = line.select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 500).alias("y"), (4 + F.col("l_discount") * 20).alias("d"))
    found = regions.corners(rings, "image")
    return found.select("image", "corner", F.least("one", "other").alias("low"), F.greatest("one", "other").alias("high"))


# --- more files, graphs, names, histories -------------------------------------------------------------------------


@query(f"""SELECT doc_id, 'IHDR' || CASE WHEN doc_id % 2 = 0 THEN ',gAMA' ELSE '' END || CASE WHEN turned BETWEEN '2' AND '8' THEN ',eXIf' ELSE '' END || ',IDAT,IEND' AS kinds, CASE WHEN doc_id % 2 = 0 THEN lower(printf('%08x', CAST(doc_id AS BIGINT))) ELSE '' END || CASE WHEN turned BETWEEN '2' AND '8' THEN {EXIF_SQL} ELSE '' END AS kept, md5(text) AS picture FROM (SELECT doc_id, text, CAST({TURNED} AS VARCHAR) AS turned FROM documents)""")
def png_clean(spark, sf_dir):
    """Of a head, a gamma, three notes, an orientation and a picture, notes go, and an orientation that turns nothing."""
    def chunk(kind, data):
        body = F.concat(F.lit(kind.encode()), data)
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), body, F.unhex(F.lpad(F.hex(F.crc32(body)), 8, "0")))

    text = F.col("text").cast("binary")
    gamma = F.when(F.col("doc_id") % 2 == 0, chunk("gAMA", F.unhex(F.lpad(F.hex("doc_id"), 8, "0")))).otherwise(F.lit(b""))
    notes = [chunk("tEXt", F.concat(F.lit(b"note\0"), text)), chunk("iTXt", text), chunk("tIME", F.lit(b"1234567"))]
    png = F.concat(F.lit(containers.SIGNATURE), chunk("IHDR", F.lit(b"\0\0\0\1\0\0\0\1\x08\0\0\0\0")), gamma, *notes, chunk("eXIf", _exif(F.col("doc_id") % 9)), chunk("IDAT", F.unhex(F.md5("text"))), chunk("IEND", F.lit(b"")))
    c = table(spark, sf_dir, "documents").select("doc_id", containers.png_chunks(cleaners.png_without_notes(png)).alias("c"))
    data = lambda *kinds: F.lower(F.array_join(F.transform(F.filter("c", lambda x: x["type"].isin(*kinds)), lambda x: F.hex(x["data"])), ""))
    return c.select("doc_id", F.array_join(F.transform("c", lambda x: x["type"]), ",").alias("kinds"), data("gAMA", "eXIf").alias("kept"), data("IDAT").alias("picture"))


@query(f"""SELECT doc_id, '52494646' || lower(printf('%02x', CAST(46 + CASE WHEN doc_id % 3 = 0 THEN 12 ELSE 0 END + CASE WHEN turned BETWEEN '2' AND '8' THEN 34 ELSE 0 END AS BIGINT))) || '000000' || '57454250' || '565038580a000000' || CASE WHEN turned BETWEEN '2' AND '8' THEN '38' ELSE '30' END || '000000000000000000' || CASE WHEN doc_id % 3 = 0 THEN '4943435004000000' || left(md5(text), 8) ELSE '' END || '5650384c10000000' || md5(text) || CASE WHEN turned BETWEEN '2' AND '8' THEN '455849461a000000' || {EXIF_SQL} ELSE '' END AS cleaned FROM (SELECT doc_id, text, CAST({TURNED} AS VARCHAR) AS turned FROM documents)""")
def webp_clean(spark, sf_dir):
    """Of flags, a colour profile, a picture, an orientation and a note, the note goes, flags and size are made right."""
    def part(kind, data):
        n = F.octet_length(data)
        return F.concat(F.lit(kind), F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"), F.lit("0000"))), data, F.when(n % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))

    digest = F.md5("text")
    profile = F.when(F.col("doc_id") % 3 == 0, part(b"ICCP", F.unhex(F.left(digest, F.lit(8))))).otherwise(F.lit(b""))
    body = F.concat(F.lit(b"WEBP"), part(b"VP8X", F.unhex(F.lit("3c000000000000000000"))), profile, part(b"VP8L", F.unhex(digest)), part(b"EXIF", F.concat(F.lit(b"Exif\0\0"), _exif(F.col("doc_id") % 9))), part(b"XMP ", F.left(digest, F.lit(31)).cast("binary")))
    n = F.octet_length(body)
    webp = F.concat(F.lit(b"RIFF"), F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"), F.lit("0000"))), body)
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(cleaners.webp_without_notes(webp))).alias("cleaned"))


@query("SELECT doc_id, text FROM documents")
def exif_comment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", metadata.picture_fields(metadata.to_exif_webp("text"))["parameters"].alias("text"))


@query("""SELECT doc_id, sha256(unhex('00000010' || '66747970' || '69736f6d00000200' || printf('%08x', CAST(40 + n AS BIGINT)) || '6d6f6f76' || '00000018' || '6d766864' || '00000000' || repeat('00', 8) || '72657374' || printf('%08x', CAST(8 + n AS BIGINT)) || '66726565' || repeat('00', n) || '00000009' || '6d646174' || '78')) AS sha256 FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""")
def mp4_clean(spark, sf_dir):
    """A film with a date and a note: the note becomes free space of its length, the date zero, and nothing moves."""
    box, text = validators.box, F.coalesce("text", F.lit("")).cast("binary")
    dated = box("mvhd", F.concat(F.lit(b"\0\0\0\0"), F.unhex(F.left(F.md5(text), F.lit(16))), F.lit(b"rest")))
    film = F.concat(box("ftyp", F.lit(b"isom\0\0\2\0")), box("moov", F.concat(dated, box("udta", text))), box("mdat", F.lit(b"x")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(cleaners.mp4_without_notes(film), 256).alias("sha256"))


@query(rf"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?i)^(enable|disable|enabled|disabled|fixed|populate|reproduce|randomize|increment|decrement|normal|default|none|cpu|cuda|auto)$|(\.(safetensors|ckpt|gguf|pth|pt)|[\\/])$') THEN '' ELSE coalesce(text, '') END AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'seen' WHEN 1 THEN CASE WHEN t = '' THEN 'near' ELSE t || chr(10) || 'near' END ELSE t END AS positive,
CASE WHEN conv_id % 4 = 3 THEN '{graphs.ZEROED}' ELSE 'worse' || coalesce(CASE WHEN role <> '' THEN ', ' || role END, '') END AS negative, CAST(CASE WHEN turn % 3 = 1 THEN 5 ELSE 4 END AS INT) AS upstream FROM c""")
def graph_prompts(spark, sf_dir):
    """A graph of each turn: its text as a primitive, next to another text or behind a snapshot by turn, and its role joined
    to a word or zeroed by conversation."""
    link = lambda node, slot=0: F.array(F.lit(node), F.lit(str(slot)))
    node = lambda kind, *inputs: F.to_json(F.struct(F.lit(kind).alias("class_type"), F.struct(*inputs).alias("inputs")))
    encoded = lambda *more: node("CLIPTextEncode", link("4").alias("text"), F.lit("x").alias("clip"), *more)
    third, zeroed = F.col("turn") % 3, F.col("conv_id") % 4 == 3
    parts = {
        "1": node("KSampler", link("2").alias("positive"), link("3").alias("negative"), F.lit(20).alias("steps"), F.lit(7).alias("cfg"), F.lit(1).alias("seed")),
        "2": F.when(third == 2, encoded(F.lit("seen").alias("populated_text"))).when(third == 1, encoded(link("5").alias("text_2"))).otherwise(encoded()),
        "3": F.when(zeroed, node("ConditioningZeroOut", F.lit("x").alias("conditioning"))).otherwise(node("StringConcatenate", F.lit("worse").alias("string_a"), F.col("role").alias("string_b"), F.lit(", ").alias("delimiter"))),
        "4": node("PrimitiveString", F.col("text").alias("value")),
        "5": node("PrimitiveString", F.lit("near").alias("value")),
    }
    graph = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", graphs.samplers(graph, F.lit(None).cast("string"))[0].alias("s"))
    return c.select("conv_id", "turn", "s.positive", "s.negative", "s.upstream")


@query(r"""SELECT p_partkey, regexp_matches(n, '\S') AND NOT regexp_matches(n, '[\x00-\x1F<>:"/\\|?*]') AND NOT regexp_matches(n, '[. ]$') AND NOT regexp_matches(upper(n), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)') AS ok
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'con.' || p_name WHEN 1 THEN p_name || ' ' WHEN 2 THEN p_name || '/x' ELSE p_name END AS n FROM part)""")
def safe_names(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("con."), n)).when(k == 1, F.concat(n, F.lit(" "))).when(k == 2, F.concat(n, F.lit("/x"))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", naming.safe_name(name).alias("ok"))


@query(r"SELECT conv_id, turn, CAST(turn + 1 AS VARCHAR) || ' · ' || CASE WHEN t = '' THEN '(empty)' WHEN length(t) > 18 THEN left(t, 18) || '…' ELSE t END AS label FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM conversations)")
def layer_captions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", naming.caption(F.col("turn"), F.col("text")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 20 THEN chr(9311 + p_size) WHEN p_size BETWEEN 21 AND 35 THEN chr(12860 + p_size) WHEN p_size BETWEEN 36 AND 50 THEN chr(12941 + p_size) ELSE CAST(p_size AS VARCHAR) END AS mark FROM part")
def ordinal_marks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", naming.circled(F.col("p_size")).alias("mark"))


@query("""SELECT doc_id, CASE WHEN n >= 1048576 THEN CAST(CAST(floor(n / 1048576.0::DOUBLE * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(n / 1048576.0::DOUBLE * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' MiB'
WHEN n >= 1024 THEN CAST(CAST(floor(n / 1024.0::DOUBLE * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(n / 1024.0::DOUBLE * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' KiB' ELSE CAST(n AS VARCHAR) || ' B' END AS size FROM (SELECT doc_id, n_chars * 7 AS n FROM documents)""")
def size_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", naming.size_text(F.col("n_chars") * 7).alias("size"))


@query("SELECT p_partkey, CAST(greatest(1, round_even(w * least(1, 640.0::DOUBLE / greatest(w, h)), 0)) AS INT) AS width, CAST(greatest(1, round_even(h * least(1, 640.0::DOUBLE / greatest(w, h)), 0)) AS INT) AS height FROM (SELECT p_partkey, p_size * 37 AS w, CAST(p_partkey % 2000 + 1 AS INT) AS h FROM part)")
def output_sizes(spark, sf_dir):
    w, h = naming.output_size(F.col("p_size") * 37, (F.col("p_partkey") % 2000 + 1).cast("int"), 640)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'sd15' ELSE 'sdxl' END AS family, CASE WHEN p_partkey % 3 = 0 THEN 'lora' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'base' ELSE 'unknown' END AS role FROM part")
def model_roles(spark, sf_dir):
    """Files of tensors, told by which names they have: one in three has adapter names, the others a whole base model but
    for the output layer in one of three; odd ones have the wider attention without its second text encoder."""
    k = F.col("p_partkey")
    whole = F.array(*map(F.lit, ("unet.conv_in.weight", "vae.encoder.a", "vae.decoder.a", "text_encoder.a", "x.attn2.to_k.weight")))
    more = F.when(k % 3 == 0, "a.lora_up.weight").when(k % 3 == 1, "unet.conv_out.weight").otherwise("other")
    names = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_append(whole, more)).alias("name"))
    return models.classified(names.withColumn("shape", F.array(F.lit(320), F.when(k % 2 == 0, 768).otherwise(2048))), "p_partkey")


@query()
def undo_history(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("push")
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", action.alias("action"), F.floor(F.col("value") * 1000).alias("bytes"))
    return replayed(events, "user_id", ["ts", "id"])


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type NOT IN ('purchase', 'error')")
def active_transfers(spark, sf_dir):
    return active(table(spark, sf_dir, "events"), "user_id", "event_type", ("purchase", "error"), ["ts", "event_id"])


# --- pictures as files -------------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT y // 64 AS image, CAST(y % 64 AS INT) AS y, x, v FROM px")
def image_png_roundtrip(spark, sf_dir):
    return images.from_png(images.as_png(_images(spark, sf_dir)))


@query(f"WITH {PX} SELECT y // 64 AS image, CAST(y % 64 AS INT) AS y, x, v FROM px")
def dual_png_roundtrip(spark, sf_dir):
    return images.from_png(images.as_dual(_images(spark, sf_dir)), last=True)


@query()
def image_gif(spark, sf_dir):
    return images.as_gif(_images(spark, sf_dir).withColumn("job", F.floor(F.col("image") / 4)), "job")


PACKED = "SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'x') || '.zip' AS name FROM documents"


def _packed(spark, sf_dir, mode, cover):
    """Texts, zipped, hidden in a cover, taken out of it and unzipped."""
    name = F.concat(F.coalesce("lang", F.lit("x")), F.lit(".zip"))
    made = packaging.packed_file(mode)(cover, validators.to_zip("text"), name)
    return table(spark, sf_dir, "documents").select("doc_id", packaging.unpacked_file(made).alias("f")).select("doc_id", validators.zip_text("f.content").alias("text"), F.col("f.name").alias("name"))


@query(PACKED)
def png_package_roundtrip(spark, sf_dir):
    return _packed(spark, sf_dir, "png", containers.to_png("source"))


@query(PACKED)
def jpeg_package_roundtrip(spark, sf_dir):
    return _packed(spark, sf_dir, "jpeg", F.lit(b"\xff\xd8\xff\xda\x00\x02\xaa\xbb\xff\xd9"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def behind_package_roundtrip(spark, sf_dir):
    return _packed(spark, sf_dir, "behind", containers.to_png("source")).select("doc_id", "text")
