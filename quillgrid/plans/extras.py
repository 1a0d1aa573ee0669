"""More queries over the driver tables: files and manifests, masks and regions, rankings, sets, reports, frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import cleaners, graphs, naming, reports, validators
from ..functions.rows import by_row
from ..operators import masks
from ..operators import raster as ops
from ..sources.ordered import beside
from ..sources.tables import raster, table
from ..streaming import frames
from .catalog import IMG, PX, _exif, _images, _kept_folder, query

L = F.lit

# --- files, manifests, folders -----------------------------------------------------------------------------------


@query("SELECT p_partkey, w >= 1 AND h >= 1 AND w <= 8192 AND h <= 8192 AND w * h <= 32000000 AS ok FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 190 - 200 AS w, p_partkey % 97 * 90 AS h FROM part)")
def size_guard(spark, sf_dir):
    """Pictures of at most 8192 pixels a side and 32 million in all."""
    w, h = F.col("p_size").cast("long") * 190 - 200, F.col("p_partkey") % 97 * 90
    return table(spark, sf_dir, "part").select("p_partkey", (w.between(1, 8192) & h.between(1, 8192) & (w * h <= 32_000_000)).alias("ok"))


OPTIONS = "o AS (SELECT o_orderkey, o_orderkey % 23 AS rounds, 1 + CAST(o_orderkey % 31 = 0 AS INT) AS version, o_orderkey % 5 AS algorithm, o_custkey % 3 AS variant, o_totalprice / 200000 AS strength, CASE o_orderkey % 4 WHEN 0 THEN '0.37' WHEN 1 THEN '1.5' WHEN 2 THEN 'x' ELSE '.5' END AS key, CASE o_custkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 12 END AS block, CASE WHEN o_orderkey % 7 = 0 THEN left(md5(o_orderpriority), 31) ELSE md5(o_orderpriority) END AS seed FROM orders)"


@query(rf"WITH {OPTIONS} SELECT o_orderkey, rounds BETWEEN 1 AND 20 AND version = 1 AND algorithm <= 3 AND variant <= 1 AND strength BETWEEN 0 AND 2 AND (algorithm NOT IN (1, 2) OR coalesce(TRY_CAST(key AS DOUBLE) > 0 AND TRY_CAST(key AS DOUBLE) < 1, false)) AND (algorithm <> 3 OR (block IN (8, 16, 32) AND regexp_matches(seed, '^[0-9a-fA-F]{{32}}$'))) AS ok FROM o")
def option_validation(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 23).alias("rounds"), F.when(k % 31 == 0, 2).otherwise(1).alias("version"), (k % 5).alias("algorithm"), (c % 3).alias("variant"), (F.col("o_totalprice") / 200000).alias("strength"),
        F.when(k % 4 == 0, "0.37").when(k % 4 == 1, "1.5").when(k % 4 == 2, "x").otherwise(".5").alias("key"), F.when(c % 4 == 0, 8).when(c % 4 == 1, 16).when(c % 4 == 2, 32).otherwise(12).alias("block"),
        F.when(k % 7 == 0, F.left(F.md5("o_orderpriority"), L(31))).otherwise(F.md5("o_orderpriority")).alias("seed"),
    )
    number = F.col("key").try_cast("double")
    common = F.col("rounds").between(1, 20) & (F.col("version") == 1) & (F.col("algorithm") <= 3) & (F.col("variant") <= 1) & F.col("strength").between(0, 2)
    keyed = ~F.col("algorithm").isin(1, 2) | F.coalesce((number > 0) & (number < 1), L(False))
    seeded = (F.col("algorithm") != 3) | (F.col("block").isin(8, 16, 32) & F.col("seed").rlike("^[0-9a-fA-F]{32}$"))
    return o.select("o_orderkey", (common & keyed & seeded).alias("ok"))


@query("SELECT p_partkey, off >= 0 AND size >= 0 AND off <= total AND size <= total - greatest(off, 0) AS ok FROM (SELECT p_partkey, 9223372036854775807 - p_partkey % 3 AS total, CASE p_partkey % 4 WHEN 0 THEN 9223372036854775800 WHEN 1 THEN -1 ELSE p_partkey END AS off, CAST(p_size AS BIGINT) AS size FROM part)")
def range_check(spark, sf_dir):
    """Whether a piece lies within a file: no sum that could overflow."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    total, off = L(9223372036854775807) - k % 3, F.when(k % 4 == 0, L(9223372036854775800)).when(k % 4 == 1, L(-1)).otherwise(k)
    return table(spark, sf_dir, "part").select("p_partkey", ((off >= 0) & (size >= 0) & (off <= total) & (size <= total - F.greatest(off, L(0)))).alias("ok"))


PATHS = "p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '../' WHEN 1 THEN 'a/../' WHEN 2 THEN 'a/../../' WHEN 3 THEN './a/' ELSE '/' END || replace(p_name, ' ', '/../') AS path FROM part)"


@query(rf"""WITH {PATHS}, s AS (SELECT p_partkey, path, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS i FROM p),
d AS (SELECT p_partkey, path, sum(CASE part WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth FROM s)
SELECT p_partkey, NOT starts_with(any_value(path), '/') AND min(depth) >= 0 AND arg_max(depth, 1) IS NOT NULL AS ok FROM d GROUP BY p_partkey""")
def path_containment(spark, sf_dir):
    """Whether a relative path never leaves its root, step by step."""
    k = F.col("p_partkey") % 5
    path = F.concat(F.when(k == 0, "../").when(k == 1, "a/../").when(k == 2, "a/../../").when(k == 3, "./a/").otherwise("/"), F.replace("p_name", L(" "), L("/../")))
    step = lambda p: F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)
    least = F.aggregate(F.split(path, "/"), F.struct(L(0).alias("at"), L(0).alias("least")), lambda a, p: F.struct((a["at"] + step(p)).alias("at"), F.least(a["least"], a["at"] + step(p)).alias("least")))["least"]
    return table(spark, sf_dir, "part").select("p_partkey", (~path.startswith("/") & (least >= 0)).alias("ok"))


@query("""WITH sent AS (SELECT doc_id, sha256(text) AS sha, length(text) AS n, source AS name FROM documents), got AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS sha, length(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS n, CASE WHEN doc_id % 15 = 0 THEN 'other' ELSE source END AS name FROM documents WHERE doc_id % 7 <> 0)
SELECT s.doc_id, g.doc_id IS NOT NULL AS arrived, coalesce(s.sha = g.sha, false) AS same_bytes, coalesce(s.n = g.n, false) AS same_length, coalesce(s.name = g.name, false) AS same_name FROM sent s LEFT JOIN got g USING (doc_id)""")
def sent_and_received(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    looked = lambda t, name: (F.sha2(t, 256).alias("sha"), F.length(t).alias("n"), name.alias("name"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", L("x"))).otherwise(F.col("text"))
    sent = d.select("doc_id", *looked(F.col("text"), F.col("source")))
    got = d.where("doc_id % 7 <> 0").select("doc_id", F.struct(*looked(changed, F.when(F.col("doc_id") % 15 == 0, "other").otherwise(F.col("source")))).alias("g"))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"g.{c}"), L(False))
    return sent.join(got, "doc_id", "left").select("doc_id", F.col("g").isNotNull().alias("arrived"), same("sha").alias("same_bytes"), same("n").alias("same_length"), same("name").alias("same_name"))


@query("""WITH m AS (SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS size FROM documents), f AS (SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN lower(text) ELSE text END) AS sha, octet_length(encode(text)) - CAST(doc_id % 11 = 0 AS INT) AS size FROM documents WHERE doc_id % 5 <> 1)
SELECT doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN f.size <> m.size THEN 'size' WHEN f.sha <> m.sha THEN 'hash' ELSE 'ok' END AS state FROM m LEFT JOIN f USING (doc_id)""")
def manifest_verified(spark, sf_dir):
    """Files against a manifest: size first, then the hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = d.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    k = F.col("doc_id")
    f = d.where("doc_id % 5 <> 1").select("doc_id", F.sha2(F.when(k % 9 == 0, F.lower("text")).otherwise(F.col("text")), 256).alias("found_sha"), (F.octet_length("text") - (k % 11 == 0).cast("int")).alias("found_size"))
    state = F.when(F.col("found_size").isNull(), "missing").when(F.col("found_size") != F.col("size"), "size").when(F.col("found_sha") != F.col("sha"), "hash").otherwise("ok")
    return m.join(f, "doc_id", "left").select("doc_id", state.alias("state"))


@query("""WITH c AS (SELECT source AS package, d AS folder, bool_and((doc_id * 7 + d) % 97 <> 0 OR d = 4) AS complete FROM documents, (SELECT unnest(range(5)) AS d) GROUP BY 1, 2)
SELECT package, min(folder) FILTER (WHERE complete) AS folder FROM c GROUP BY package""")
def first_complete_folder(spark, sf_dir):
    """Of the folders that may hold a package the first, by order, where all its files verify."""
    tried = table(spark, sf_dir, "documents").select(F.col("source").alias("package"), "doc_id", F.explode(F.sequence(L(0).cast("long"), L(4).cast("long"))).alias("folder"))
    ok = ((F.col("doc_id") * 7 + F.col("folder")) % 97 != 0) | (F.col("folder") == 4)
    complete = tried.groupBy("package", "folder").agg(F.bool_and(ok).alias("complete"))
    return complete.groupBy("package").agg(F.min(F.when(F.col("complete"), F.col("folder"))).alias("folder"))


FOLDERS = "a AS (SELECT lower(c_name) AS path, c_custkey % 3 AS kind, c_custkey AS n FROM customer UNION ALL SELECT upper(c_name), c_custkey % 4, c_custkey FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {FOLDERS}, u AS (SELECT lower(path) AS path, min(kind * 1000000 + n) AS place FROM a GROUP BY 1) SELECT path, row_number() OVER (ORDER BY place, path) AS rank FROM u ORDER BY place, path LIMIT 48")
def package_search_order(spark, sf_dir):
    """Where to look for packages: explicit roots, then folders, then snapshots; each path once, whatever its case, 48 at most."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    every = c.select(F.lower("c_name").alias("path"), (k % 3 * 1_000_000 + k).alias("place")).unionByName(c.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("path"), (k % 4 * 1_000_000 + k).alias("place")))
    once = every.groupBy(F.lower("path").alias("path")).agg(F.min("place").alias("place")).orderBy("place", "path").limit(48)
    return once.select("path", F.row_number().over(Window.orderBy("place", "path")).cast("long").alias("rank"))


@query("SELECT lower(p_brand) AS path, arg_min(p_partkey, CAST(p_size <> 25 AS BIGINT) * 1000000000 + p_partkey) AS p_partkey, count(*) AS copies FROM part GROUP BY 1")
def one_per_path(spark, sf_dir):
    """One file of each path, whatever its case: a verified one if there is any, else the first."""
    best = F.min(F.struct((F.col("p_size") != 25).alias("unverified"), "p_partkey")).alias("best")
    return table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("path")).agg(best, F.count("*").alias("copies")).select("path", "best.p_partkey", "copies")


@query("SELECT p_type AS value, min(p_partkey) AS first FROM part GROUP BY p_type")
def reverse_look_up(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.min("p_partkey").alias("first"))


MANIFEST = "m AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN p_brand ELSE 'made/' || replace(p_brand, '#', '_') END AS repo, left(sha256(p_name), CASE WHEN p_partkey % 17 = 0 THEN 39 ELSE 40 END) AS revision, sha256(p_type) AS sha, CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE p_partkey * 4096 END AS size, 'w/' || CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE p_partkey END || CASE WHEN p_partkey % 29 = 0 THEN '.part' ELSE '.bin' END AS target FROM part)"


@query(rf"WITH {MANIFEST} SELECT p_partkey, regexp_matches(repo, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') AND regexp_matches(revision, '^[a-f0-9]{{40}}$') AND regexp_matches(sha, '^[a-f0-9]{{64}}$') AND size BETWEEN 1 AND 68719476736 AND NOT ends_with(target, '.part') AND count(*) OVER (PARTITION BY target) = 1 AS ok FROM m")
def manifest_validation(spark, sf_dir):
    """Pinned files: names, revisions and hashes of the right form, sizes within bounds, and no target twice."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 13 == 0, F.col("p_brand")).otherwise(F.concat(L("made/"), F.replace("p_brand", L("#"), L("_")))).alias("repo"),
        F.left(F.sha2("p_name", 256), F.when(k % 17 == 0, 39).otherwise(40)).alias("revision"), F.sha2("p_type", 256).alias("sha"), F.when(k % 19 == 0, 0).otherwise(k * 4096).alias("size"),
        F.concat(L("w/"), F.when(k % 23 == 0, 1).otherwise(k).cast("string"), F.when(k % 29 == 0, ".part").otherwise(".bin")).alias("target"),
    )
    formed = F.col("repo").rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & F.col("revision").rlike("^[a-f0-9]{40}$") & F.col("sha").rlike("^[a-f0-9]{64}$") & F.col("size").between(1, 64 << 30) & ~F.col("target").endswith(".part")
    # a target used once has one row, whose key is kept in its count: the rows of one used often are counted where they are
    once = m.groupBy("target").agg(F.count("*").alias("uses"), F.min("p_partkey").alias("p_partkey")).where("uses = 1").select("p_partkey", L(True).alias("once"))
    return m.join(once, "p_partkey", "left").select("p_partkey", (formed & F.coalesce("once", L(False))).alias("ok"))


@query("SELECT family, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) FILTER (WHERE NOT there) AS BIGINT) AS wanted, CAST(coalesce(sum(size) FILTER (WHERE NOT there), 0) + 1073741824 AS BIGINT) AS room FROM (SELECT p_size % 3 AS family, p_partkey * 1000 AS size, p_partkey % 4 = 0 AS there FROM part) GROUP BY family")
def storage_plan(spark, sf_dir):
    """Bytes of a family's files, of those not there yet, and the room to ask for."""
    m = table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("family"), (F.col("p_partkey") * 1000).alias("size"), (F.col("p_partkey") % 4 == 0).alias("there"))
    wanted = F.sum(F.when(~F.col("there"), F.col("size")))
    return m.groupBy("family").agg(F.sum("size").alias("bytes"), wanted.alias("wanted"), (F.coalesce(wanted, L(0)) + (1 << 30)).alias("room"))


@query("SELECT coalesce(min(upper(left(s_name, 1)) || ':' || s_suppkey) FILTER (WHERE s_nationkey % 2 = 0 AND s_acctbal >= 5000), 'D:') AS drive FROM supplier")
def drive_selection(spark, sf_dir):
    """The first ready fixed drive with room, by letter; a suggestion where there is none."""
    name = F.concat(F.upper(F.left("s_name", L(1))), L(":"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").agg(F.coalesce(F.min(F.when((F.col("s_nationkey") % 2 == 0) & (F.col("s_acctbal") >= 5000), name)), L("D:")).alias("drive"))


@query("SELECT s_nationkey, arg_min(s_suppkey, [CAST(NOT reachable AS DOUBLE), CASE WHEN reachable THEN latency ELSE 0 END, s_suppkey]) AS s_suppkey FROM (SELECT *, s_acctbal > 0 AS reachable, abs(s_acctbal) AS latency FROM supplier) GROUP BY s_nationkey")
def source_selection(spark, sf_dir):
    """The source to load from: reachable ones first, the quickest of those."""
    up = F.col("s_acctbal") > 0
    best = F.min(F.struct((~up).alias("down"), F.when(up, F.abs("s_acctbal")).otherwise(0.0).alias("latency"), "s_suppkey")).alias("best")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(best).select("s_nationkey", "best.s_suppkey")


SCORE = "abs(ln(CAST(w AS DOUBLE) * h / 307200)) + CASE WHEN greatest(w, h) > 1280 THEN 8 ELSE 0 END + CASE WHEN least(w, h) < 240 THEN 4 ELSE 0 END"


@query(f"SELECT brand, arg_min(p_partkey, [round({SCORE}, 6), p_partkey]) AS p_partkey FROM (SELECT p_partkey, p_brand AS brand, p_size * 40 AS w, p_size * 30 + p_partkey % 200 AS h FROM part) GROUP BY brand")
def camera_size(spark, sf_dir):
    """The picture size of each device that is nearest to 640 x 480."""
    w, h = F.col("p_size") * 40, F.col("p_size") * 30 + F.col("p_partkey") % 200
    score = F.abs(F.log(w.cast("double") * h / 307200)) + F.when(F.greatest(w.cast("long"), h) > 1280, 8).otherwise(0) + F.when(F.least(w.cast("long"), h) < 240, 4).otherwise(0)
    best = F.min(F.struct(F.round(score, 6).alias("score"), "p_partkey")).alias("best")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(best).select("brand", "best.p_partkey")


# --- masks and regions -------------------------------------------------------------------------------------------


@query(f"WITH {PX}, {IMG} SELECT image, bool_or(least(255, v + 105) < 255) AS transparent FROM img GROUP BY image")
def transparency_exists(spark, sf_dir):
    return _images(spark, sf_dir).groupBy("image").agg(F.bool_or(F.least(L(255), F.col("v") + 105) < 255).alias("transparent"))


@query("SELECT user_id, NOT bool_or(event_type = 'purchase') AND (bool_or(event_type = 'signup') OR bool_or(event_type = 'error' AND value > 90)) AS legacy FROM events GROUP BY user_id")
def legacy_dual(spark, sf_dir):
    """Over the chunks of a file: none that animates, and one of those that older files were made with."""
    kind = lambda t: F.col("event_type") == t
    return table(spark, sf_dir, "events").groupBy("user_id").agg((~F.bool_or(kind("purchase")) & (F.bool_or(kind("signup")) | F.bool_or(kind("error") & (F.col("value") > 90)))).alias("legacy"))


@query(f"WITH {PX}, {IMG} SELECT image, y, x, v > 120 OR v % 5 = 0 AS either, v > 120 AND v % 5 = 0 AS both, CAST(least(255, v + (v * 3) % 256) AS INT) AS added, greatest(v, (v * 3) % 256) AS lighter FROM img")
def mask_algebra(spark, sf_dir):
    a, b, other = F.col("v") > 120, F.col("v") % 5 == 0, F.col("v") * 3 % 256
    return _images(spark, sf_dir).select("image", "y", "x", (a | b).alias("either"), (a & b).alias("both"), F.least(L(255), F.col("v") + other).alias("added"), F.greatest(F.col("v"), other).alias("lighter"))


PARTS = """m AS (SELECT image, y, x, image * 4096 + y * 64 + x AS i FROM img WHERE v > 150), e AS ({0}), r AS (SELECT i AS root, i FROM m UNION SELECT r.root, e.j FROM r JOIN e ON e.i = r.i), l AS (SELECT i, min(root) AS label FROM r GROUP BY i)"""
STEP = "SELECT a.i, b.i AS j FROM m a JOIN m b ON b.i = a.i + {d} AND b.image = a.image AND b.x - a.x = {dx}"


def _edges(steps):
    return " UNION ALL ".join(STEP.format(d=dy * 64 + dx, dx=dx) for dy, dx in steps)


@query(f"WITH RECURSIVE {PX}, {IMG}, {PARTS.format(_edges(masks.SIDES_8))} SELECT image, label, count(*) AS area, min(x) AS left_x, max(x) AS right_x, min(y) AS top_y, max(y) AS bottom_y, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM l JOIN m USING (i) GROUP BY image, label")
def part_statistics(spark, sf_dir):
    """Area, box and sums of the parts of bright pixels that touch, corners too."""
    _kept_folder(spark)
    parts = masks.part_statistics(masks.spread(_images(spark, sf_dir).where("v > 150"), masks.SIDES_8))
    label = F.col("image") * 4096 + F.col("label.y") * 64 + F.col("label.x")
    return parts.select("image", label.alias("label"), "area", *[F.col(a).alias(f"{a}_{b}") for a, b in (("left", "x"), ("right", "x"), ("top", "y"), ("bottom", "y"))], "sum_x", "sum_y")


@query(f"WITH RECURSIVE {PX}, {IMG}, {PARTS.format(_edges(masks.SIDES_4)).replace('v > 150', 'v > 145')}, b AS (SELECT DISTINCT image, label FROM l JOIN m USING (i) WHERE x IN (0, 63) OR y IN (0, 63)) SELECT m.image, m.y, m.x FROM l JOIN m USING (i) JOIN b ON b.image = m.image AND b.label = l.label")
def border_background(spark, sf_dir):
    """Blank pixels that are connected with the border of their picture."""
    _kept_folder(spark)
    return masks.border_parts(_images(spark, sf_dir).where("v > 145"), 64, 64)


@query(f"""WITH {PX}, {IMG}, n AS (SELECT *, x >= 16 AND x < 40 AND y >= 8 AND y < 32 AS inside FROM img),
w AS (SELECT * FROM n WHERE x BETWEEN 8 AND 47 AND y BETWEEN 0 AND 39),
m AS (SELECT image, (y - 0) // 8 AS by, (x - 8) // 8 AS bx, CAST(sum(v) // count(*) AS INT) AS mean FROM w GROUP BY ALL),
h AS (SELECT image, y, x, sum(v) OVER s // count(v) OVER s AS v FROM w WINDOW s AS (PARTITION BY image, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
u AS (SELECT image, y, x, CAST(sum(v) OVER s // count(v) OVER s AS INT) AS blurred FROM h WINDOW s AS (PARTITION BY image, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT n.image, n.y, n.x, CASE WHEN inside THEN 0 ELSE v END AS solid, CASE WHEN inside THEN mean ELSE v END AS mosaic, CASE WHEN inside THEN blurred ELSE v END AS blurred FROM n LEFT JOIN m ON m.image = n.image AND m.by = n.y // 8 AND m.bx = (n.x - 8) // 8 AND inside LEFT JOIN u ON u.image = n.image AND u.y = n.y AND u.x = n.x""")
def redaction(spark, sf_dir):
    """A rectangle of each picture filled, as a mosaic and blurred."""
    p, box = _images(spark, sf_dir), (16, 8, 40, 32)
    for effect, name in (("solid", "solid"), ("mosaic", "mosaic"), ("blur", "blurred")):
        p = masks.with_redaction(p, *box, effect, 8, name)
    return p.select("image", "y", "x", "solid", "mosaic", "blurred")


LABELS = "lab AS (SELECT image, y, x, CASE WHEN v BETWEEN 118 AND 122 THEN (v + y // 16) % 18 WHEN v > 126 THEN 4 ELSE 0 END AS label FROM img)"


def _labels(spark, sf_dir):
    v, y = F.col("v"), F.floor(F.col("y") / 16)
    return _images(spark, sf_dir).select("image", "y", "x", F.when(v.between(118, 122), (v + y) % 18).when(v > 126, 4).otherwise(0).cast("int").alias("label"))


@query(f"""WITH {PX}, {IMG}, {LABELS}, k AS (SELECT image, y, x FROM lab WHERE label IN {masks.KEPT}), g AS (SELECT DISTINCT k.image, k.y + dy AS y, k.x + dx AS x FROM k, (SELECT unnest(range(-5, 6)) AS dy), (SELECT unnest(range(-5, 6)) AS dx))
SELECT l.image, l.y, l.x, CASE WHEN label = 0 AND g.x IS NULL THEN 255 ELSE 0 END AS background, CASE WHEN label <> 0 AND label NOT IN {masks.KEPT} AND g.x IS NULL THEN 255 ELSE 0 END AS cloth FROM lab l LEFT JOIN g ON g.image = l.image AND g.y = l.y AND g.x = l.x""")
def material_masks(spark, sf_dir):
    return masks.material_masks(_labels(spark, sf_dir))


SKIN_LAB = "lab AS (SELECT image, y, x, CASE WHEN v BETWEEN 60 AND 134 THEN 12 WHEN v > 150 THEN 11 ELSE 0 END AS label FROM img)"


@query(f"""WITH {PX}, {IMG}, {SKIN_LAB}, o AS (SELECT DISTINCT k.image, k.y + dy AS y, k.x + dx AS x FROM (SELECT * FROM lab WHERE label NOT IN {masks.SKIN}) k, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
f AS (SELECT DISTINCT k.image, k.y + dy AS y, k.x + dx AS x FROM (SELECT * FROM lab WHERE label IN {masks.IDENTITY}) k, (SELECT unnest(range(-5, 6)) AS dy), (SELECT unnest(range(-5, 6)) AS dx))
SELECT l.image, l.y, l.x, o.x IS NULL AND f.x IS NULL AND l.x >= 16 AS allowed FROM lab l LEFT JOIN o ON o.image = l.image AND o.y = l.y AND o.x = l.x LEFT JOIN f ON f.image = l.image AND f.y = l.y AND f.x = l.x""")
def skin_mask(spark, sf_dir):
    v = F.col("v")
    labels = _images(spark, sf_dir).select("image", "y", "x", F.when(v.between(60, 134), 12).when(v > 150, 11).otherwise(0).alias("label"))
    return masks.skin_mask(labels, F.col("x") >= 16)


def _channel_sql(offset: str) -> str:
    return f"CAST(round_even(least(255, greatest(0, yy + ({offset}) * sat)), 0) AS INT)"


def _room_sql(offset: str) -> str:
    return f"CASE WHEN ({offset}) >= 0 THEN (255 - yy) / greatest({offset}, 0.00001::DOUBLE) ELSE yy / greatest(-({offset}), 0.00001::DOUBLE) END"


OFFSETS = ("cr * 1.402::DOUBLE", "cb * -0.344136::DOUBLE - cr * 0.714136::DOUBLE", "cb * 1.772::DOUBLE")


@query(f"""WITH {PX}, c AS (SELECT y, x, CAST(v AS DOUBLE) AS yy, CAST((v * 3) % 256 - 128 AS DOUBLE) AS cb, CAST((v * 5) % 256 - 128 AS DOUBLE) AS cr FROM px),
s AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least({", ".join(map(_room_sql, OFFSETS))}))) AS sat FROM c) SELECT y, x, {_channel_sql(OFFSETS[0])} AS red, {_channel_sql(OFFSETS[1])} AS green, {_channel_sql(OFFSETS[2])} AS blue FROM s""")
def matching_palette(spark, sf_dir):
    v = F.col("v")
    out = masks.palette(v.cast("double"), (v * 3 % 256 - 128).cast("double"), (v * 5 % 256 - 128).cast("double"))
    return raster(spark, sf_dir).select("y", "x", *[c.alias(n) for c, n in zip(out, ("red", "green", "blue"))])


@query(f"""WITH {PX}, d AS (SELECT y // 16 AS ty, CAST(x // 16 AS INT) AS tx, abs(v - lag(v) OVER (PARTITION BY y, x // 16 ORDER BY x)) AS across, abs(v - lag(v) OVER (PARTITION BY x, y // 16 ORDER BY y)) AS down FROM px)
SELECT ty, tx, round(sum(across) / nullif(count(across), 0)::DOUBLE + coalesce(sum(down) / nullif(count(down), 0)::DOUBLE, 0), 6) AS score FROM d GROUP BY ALL""")
def texture_score(spark, sf_dir):
    """Mean difference of neighbours along both axes within tiles of 16 x 16: rows of the table are rows of a tile, so one
    window over a tile's few pixels is all that is sorted."""
    p = raster(spark, sf_dir).select(F.floor(F.col("y") / 16).alias("ty"), F.floor(F.col("x") / 16).cast("int").alias("tx"), "y", "x", "v")
    across = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("ty", "tx", "y").orderBy("x")))
    down = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("ty", "tx", "x").orderBy("y")))
    told = p.select("ty", "tx", across.alias("across"), down.alias("down"))
    return told.groupBy("ty", "tx").agg(F.round(F.avg("across") + F.coalesce(F.avg("down"), L(0.0)), 6).alias("score"))


@query(f"""WITH {PX}, t AS (SELECT y // 64 AS image, CAST(y % 64 // 8 * 8 AS INT) AS top, CAST(x // 8 * 8 AS INT) AS left_x, CAST(sum(v) AS BIGINT) AS score FROM px GROUP BY ALL),
a AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, left_x DESC, top DESC) = 1),
b AS (SELECT t.* FROM t JOIN a USING (image) WHERE NOT (abs(t.left_x - a.left_x) < 9.6 AND abs(t.top - a.top) < 9.6) QUALIFY row_number() OVER (PARTITION BY t.image ORDER BY t.score DESC, t.left_x DESC, t.top DESC) = 1)
SELECT image, 1 AS rank, left_x, top, score FROM a UNION ALL SELECT image, 2, left_x, top, score FROM b""")
def detail_regions(spark, sf_dir):
    """The two best regions of each picture that stand apart."""
    t = _images(spark, sf_dir).groupBy("image", F.expr("CAST(y DIV 8 * 8 AS INT)").alias("top"), F.expr("CAST(x DIV 8 * 8 AS INT)").alias("left_x")).agg(F.sum("v").alias("score"))
    best = lambda df: df.groupBy("image").agg(F.max(F.struct("score", "left_x", "top")).alias("b")).select("image", "b.*")
    a = best(t)
    apart = (F.abs(t["left_x"] - F.col("a.left_x")) >= 9.6) | (F.abs(t["top"] - F.col("a.top")) >= 9.6)
    b = best(t.join(a.alias("a"), "image").where(apart).select("image", t["top"], t["left_x"], t["score"]))
    columns = lambda df, rank: df.select("image", L(rank).alias("rank"), "left_x", "top", "score")
    return columns(a, 1).unionByName(columns(b, 2))


CORNERS = "c AS (SELECT image, ty, tx, avg(p) AS cover, {0} FROM (SELECT image, CAST(y // 16 AS INT) AS ty, CAST(x // 16 AS INT) AS tx, y % 16 AS yy, x % 16 AS xx, CAST(v > 135 AS INT) AS p FROM img) GROUP BY ALL)"
AT = ("yy < 8 AND xx < 8", "yy < 8 AND xx >= 8", "yy >= 8 AND xx >= 8", "yy >= 8 AND xx < 8")


@query(f"""WITH {PX}, {IMG}, {CORNERS.format(", ".join(f"avg(p) FILTER (WHERE {a}) AS m{i}" for i, a in enumerate(AT)))},
r AS (SELECT image, ty, tx, cover, unnest([0, 90, 180, 270]) AS rotation, unnest([[m0, m1, m3], [m0, m2, m3], [m1, m2, m3], [m0, m1, m2]]) AS markers FROM c),
s AS (SELECT image, ty, tx, rotation, round(cover + list_sum(markers) / 3 * 4 + list_max(markers) * 2 + sqrt(ty * ty + tx * tx) / 4 * 0.015::DOUBLE, 6) AS cost FROM r WHERE markers[1] IS NOT NULL AND list_count(markers) = 3)
SELECT image, ty, tx, rotation, cost FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY cost, ty, tx, rotation) = 1""")
def placement_rotations(spark, sf_dir):
    """The place and quarter turn of each picture where a code's three corners cover least of what is kept; whole tiles only."""
    p = _images(spark, sf_dir).select("image", F.expr("CAST(y DIV 16 AS INT)").alias("ty"), F.expr("CAST(x DIV 16 AS INT)").alias("tx"), (F.col("y") % 16 < 8).alias("up"), (F.col("x") % 16 < 8).alias("near"), (F.col("v") > 135).cast("int").alias("p"))
    up, near = F.col("up"), F.col("near")
    corners = [F.avg(F.when(c, F.col("p"))).alias(f"m{i}") for i, c in enumerate((up & near, up & ~near, ~up & ~near, ~up & near))]
    c = p.groupBy("image", "ty", "tx").agg(F.avg("p").alias("cover"), *corners)
    turns = F.array(*[F.struct(L(r).alias("rotation"), F.array(*[F.col(f"m{i}") for i in range(4) if i != missing]).alias("markers")) for r, missing in ((0, 2), (90, 1), (180, 0), (270, 3))])
    told = c.select("image", "ty", "tx", "cover", F.explode(turns).alias("t")).where(F.forall("t.markers", lambda m: m.isNotNull()))
    total = F.aggregate("t.markers", L(0.0), lambda a, m: a + m)
    cost = F.round(F.col("cover") + total / 3 * 4 + F.array_max("t.markers") * 2 + F.sqrt(F.col("ty") * F.col("ty") + F.col("tx") * F.col("tx")) / 4 * 0.015, 6)
    return told.groupBy("image").agg(F.min(F.struct(cost.alias("cost"), "ty", "tx", F.col("t.rotation").alias("rotation"))).alias("b")).select("image", "b.ty", "b.tx", "b.rotation", "b.cost")


@query(f"""WITH {PX}, b AS (SELECT y, x, v > 127 AS ink FROM px), s AS (SELECT y, x, ink, coalesce(CAST(ink <> lag(ink) OVER (PARTITION BY y ORDER BY x) AS INT), 0) AS new FROM b),
g AS (SELECT y, sum(new) OVER (PARTITION BY y ORDER BY x) AS run FROM s), n AS (SELECT y, run, count(*) AS n FROM g GROUP BY ALL)
SELECT y // 4 AS block, CAST(list_reduce(list(n), lambda a, b: gcd(a, b)) AS INT) AS module FROM n GROUP BY 1""")
def module_size(spark, sf_dir):
    """The greatest common divisor of all runs of dark and light in four rows: no row is taken apart, runs are its changes."""
    e = table(spark, sf_dir, "embeddings")
    value = lambda f: F.least(L(255), F.greatest(L(0), F.floor((f.cast("double") + 1) * 127.5 + 0.5)))
    ink = e.select(F.floor(F.col("vec_id") / 4).alias("block"), F.transform("embedding", lambda f: value(f) > 127).alias("ink"))
    edges = ink.select("block", F.size("ink").alias("n"), F.filter(F.sequence(L(1), F.size("ink") - 1), lambda i: F.get("ink", i) != F.get("ink", i - 1)).alias("at"))
    ends = F.concat(F.array(L(0)), "at", F.array("n"))
    runs = edges.select("block", F.zip_with(F.slice(ends, L(2), F.size(ends) - 1), F.slice(ends, L(1), F.size(ends) - 1), lambda b, a: b - a).alias("runs"))
    divides = F.array(*[F.forall("runs", lambda r: r % d == 0).cast("int") for d in range(1, 65)])  # noqa: B023
    kept = runs.select("block", divides.alias("d")).groupBy("block").agg(*[F.min(F.get("d", i)).alias(f"d{i + 1}") for i in range(64)])
    return kept.select("block", F.greatest(*[F.when(F.col(f"d{i}") == 1, i).otherwise(0) for i in range(1, 65)]).alias("module"))


@query(f"""WITH {PX}, {IMG}, o AS (SELECT image, k AS variant, v / 255.0::DOUBLE AS r, (y * 7 + x * (k + 1)) % 3 = 0 AS code FROM img, (SELECT unnest(range(8)) AS k)),
c AS (SELECT image, variant, round(avg(CASE WHEN code THEN greatest(0.6::DOUBLE - r, 0) ** 2 ELSE greatest(r - 0.35::DOUBLE, 0) ** 2 END), 9) AS cost FROM o GROUP BY ALL)
SELECT image, CAST(arg_min(variant, [cost, variant]) AS INT) AS variant, min(cost) AS cost FROM c GROUP BY image""")
def mask_choice(spark, sf_dir):
    """Which of eight patterns asks least of a picture's light and shadow."""
    p = _images(spark, sf_dir)
    r = F.col("v") / L(255.0)
    costs = []
    for k in range(8):
        code = (F.col("y") * 7 + F.col("x") * (k + 1)) % 3 == 0
        costs.append(F.round(F.avg(F.when(code, F.pow(F.greatest(0.6 - r, L(0.0)), L(2.0))).otherwise(F.pow(F.greatest(r - 0.35, L(0.0)), L(2.0)))), 9).alias(f"c{k}"))
    best = F.array_min(F.array(*[F.struct(F.col(f"c{k}").alias("cost"), L(k).alias("variant")) for k in range(8)]))
    return p.groupBy("image").agg(*costs).select("image", best.alias("b")).select("image", "b.variant", "b.cost")


@query(f"WITH {PX} SELECT v AS bin, count(*) AS n, CAST(sum(v) AS BIGINT) AS red, CAST(sum((v * 3) % 256) AS BIGINT) AS green, CAST(sum((v * 5) % 256) AS BIGINT) AS blue, CAST(sum(greatest(v, (v * 3) % 256, (v * 5) % 256) - least(v, (v * 3) % 256, (v * 5) % 256)) AS BIGINT) AS chroma FROM px GROUP BY v")
def colour_sums(spark, sf_dir):
    rgb = [F.col("v") * k % 256 for k in (1, 3, 5)]
    chroma = F.greatest(*rgb) - F.least(*rgb)
    return raster(spark, sf_dir).groupBy(F.col("v").alias("bin")).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for c, n in zip(rgb, ("red", "green", "blue"))], F.sum(chroma).alias("chroma"))


@query(f"WITH {PX}, {IMG} SELECT image, round(sum(least(40, (v * 7) % 256)) / nullif(sum((v * 7) % 256), 0)::DOUBLE, 9) AS strength FROM img GROUP BY image")
def effective_strength(spark, sf_dir):
    """How much colour was kept of what a picture had."""
    had = F.col("v") * 7 % 256
    return _images(spark, sf_dir).groupBy("image").agg(F.round(F.sum(F.least(L(40), had)) / F.nullif(F.sum(had), L(0)), 9).alias("strength"))


@query("""WITH s AS (SELECT p_partkey, p_size * 30 AS w, p_partkey % 900 + 1 AS h FROM part), e AS (SELECT *, least(768, w, h) AS edge FROM s), t AS (SELECT *, greatest(1, edge * 3 // 4) AS step FROM e),
xs AS (SELECT DISTINCT p_partkey, x FROM (SELECT p_partkey, unnest(range(0, w - edge + 1, step)) AS x FROM t UNION ALL SELECT p_partkey, w - edge FROM t)), ys AS (SELECT DISTINCT p_partkey, y FROM (SELECT p_partkey, unnest(range(0, h - edge + 1, step)) AS y FROM t UNION ALL SELECT p_partkey, h - edge FROM t))
SELECT p_partkey, edge, (SELECT count(*) FROM xs WHERE xs.p_partkey = t.p_partkey) AS columns, (SELECT count(*) FROM ys WHERE ys.p_partkey = t.p_partkey) AS lines, w - edge AS last_x, h - edge AS last_y FROM t""")
def tiling(spark, sf_dir):
    """Tiles of at most 768 pixels that overlap by a quarter and end at the picture's edges."""
    s = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 30).cast("long").alias("w"), (F.col("p_partkey") % 900 + 1).alias("h"))
    t = s.withColumn("edge", F.least(L(768).cast("long"), "w", "h")).withColumn("step", F.greatest(L(1).cast("long"), F.floor(F.col("edge") * 3 / 4)))
    starts = lambda side: F.size(F.array_distinct(F.array_append(F.sequence(L(0).cast("long"), F.col(side) - F.col("edge"), F.col("step")), F.col(side) - F.col("edge")))).cast("long")
    return t.select("p_partkey", "edge", starts("w").alias("columns"), starts("h").alias("lines"), (F.col("w") - F.col("edge")).alias("last_x"), (F.col("h") - F.col("edge")).alias("last_y"))


@query("SELECT p_partkey, greatest(1, CAST(round_even(iw * r, 0) AS BIGINT)) AS width, greatest(1, CAST(round_even(ih * r, 0) AS BIGINT)) AS height, (640 - greatest(1, CAST(round_even(iw * r, 0) AS BIGINT))) // 2 AS left_x, (480 - greatest(1, CAST(round_even(ih * r, 0) AS BIGINT))) // 2 AS top FROM (SELECT p_partkey, p_size * 37 AS iw, p_partkey % 2000 + 1 AS ih, least(640.0::DOUBLE / (p_size * 37), 480.0::DOUBLE / (p_partkey % 2000 + 1)) AS r FROM part)")
def fit_letterbox(spark, sf_dir):
    """Where a picture comes to lie in a frame of 640 x 480."""
    w, h, left, top = naming.fitted(F.col("p_size") * 37, F.col("p_partkey") % 2000 + 1, 640, 480)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), left.alias("left_x"), top.alias("top"))


@query("SELECT l_orderkey AS image, array_to_string(list(top || ':' || left_x ORDER BY top, left_x)[:32], ',') AS codes FROM (SELECT l_orderkey, l_linenumber * 3 AS top, CAST(l_quantity AS INT) AS left_x FROM lineitem) GROUP BY 1")
def detected_codes(spark, sf_dir):
    """The codes of each picture from top to bottom and left to right, 32 at most."""
    codes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 3).alias("top"), F.col("l_quantity").cast("int").alias("left_x"))
    # limited before it is collected, and within each task first
    codes = codes.withColumn("n", F.row_number().over(Window.partitionBy("image").orderBy("top", "left_x"))).where("n <= 32")
    line = codes.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("top", "left_x"))).alias("c"))
    return line.select("image", F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["top"].cast("string"), c["left_x"].cast("string"))), ",").alias("codes"))


#: The raster cut into whole pictures: what the last one lacks are the first rows again.
IMGW = "img AS (SELECT y // 64 AS image, y % 64 AS y, x, v FROM (SELECT y, x, v FROM px UNION ALL SELECT y + n, x, v FROM px, (SELECT max(y) + 1 AS n FROM px) WHERE y < (64 - n % 64) % 64))"


def _completed(spark, sf_dir):
    """The raster with its first rows again behind its last one, up to a whole picture; and its height then."""
    p = raster(spark, sf_dir)
    last = p.agg(F.max("y")).first()[0]
    rows = 0 if last is None else last + 1
    lacks = -rows % 64
    return p.unionByName(p.where(F.col("y") < lacks).withColumn("y", F.col("y") + rows)), rows + lacks


def _whole_images(spark, sf_dir):
    return _completed(spark, sf_dir)[0].select(F.floor(F.col("y") / 64).alias("image"), (F.col("y") % 64).cast("int").alias("y"), "x", "v")


def _curve_sql() -> str:
    cells = ops.curve(64, 64)
    return f"cv AS (SELECT unnest(range(4096)) AS p, unnest({[x for x, _ in cells]}) AS x, unnest({[y for _, y in cells]}) AS y)"


def _search_sql(strength: str, preferred_rounds: int) -> str:
    return f"""s0 AS (SELECT s, r, row_number() OVER (ORDER BY s <> {strength}, s, r <> {preferred_rounds}, r) AS visit FROM (SELECT DISTINCT unnest(list_append([i / 10.0::DOUBLE FOR i IN range(21)], {strength}::DOUBLE)) AS s), (SELECT unnest(range(1, 21)) AS r)),
o AS (SELECT CAST(floor(s * ((sqrt(5.0::DOUBLE) - 1) / 2) * 4096 + 0.5) AS BIGINT) % 4096 * r % 4096 AS off, arg_min(s, visit) AS s, arg_min(r, visit) AS r FROM s0 GROUP BY 1)"""


def _curve_scores_sql(offsets: str) -> str:
    return f"""WITH {PX}, {IMGW}, {_curve_sql()}, {offsets}, w AS (SELECT image FROM img GROUP BY image HAVING count(*) = 4096), line AS (SELECT image, p, v FROM img JOIN cv USING (y, x) JOIN w USING (image)),
n AS (SELECT a.p AS p, b.p AS q FROM cv a JOIN cv b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)),
sc AS (SELECT a.image, off, any_value(s) AS s, any_value(r) AS r, round(avg(abs(a.v - b.v)), 6) AS score FROM n, o JOIN line a ON a.p = (n.p + off) % 4096 JOIN line b ON b.image = a.image AND b.p = (n.q + off) % 4096 GROUP BY a.image, off)"""


@query(_curve_scores_sql(_search_sql("1.05", 2)) + """ SELECT image, CAST(row_number() OVER k AS INT) AS rank, s AS strength, CAST(r AS INT) AS rounds, off AS "offset", score FROM sc WINDOW k AS (PARTITION BY image ORDER BY score, round(abs(s - 1.05), 6), r <> 2, r, s) QUALIFY row_number() OVER k <= 3""")
def rank_curve_parameters(spark, sf_dir):
    """Strength and rounds of a shift along the curve, 22 strengths by 20 rounds, for each whole picture."""
    return ops.rank_along_curve(_whole_images(spark, sf_dir), 64, ops.Search(1.05, 2))


@query(_curve_scores_sql("o AS (SELECT CAST(floor((sqrt(5.0::DOUBLE) - 1) / 2 * 4096 + 0.5) AS BIGINT) % 4096 * r % 4096 AS off, 1.0::DOUBLE AS s, r FROM (SELECT unnest(range(1, 21)) AS r))") + """ SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY score, r) AS INT) AS rank, CAST(r AS INT) AS rounds, off AS "offset", score FROM sc""")
def rank_curve_rounds(spark, sf_dir):
    """1 to 20 rounds of one strength along the curve, for each whole picture."""
    tried = [(o, s, r) for r in range(1, 21) for o, s in [(ops.shift(4096, 1.0) * r % 4096, 1.0)]]
    return ops.rank_along_curve(_whole_images(spark, sf_dir), 64, ops.Given(1.0, 1, tuple(tried)), top=20).drop("strength")


@query(f"WITH {PX}, {IMGW}, {_curve_sql()}, w AS (SELECT image FROM img GROUP BY image HAVING count(*) = 4096), line AS (SELECT image, p, v FROM img JOIN cv USING (y, x) JOIN w USING (image)) SELECT c.y, c.x, l.image, l.v FROM cv c JOIN line l ON l.p = (c.p + CAST(floor((sqrt(5.0::DOUBLE) - 1) / 2 * 4096 + 0.5) AS BIGINT) % 4096) % 4096")
def curve_scramble(spark, sf_dir):
    """Pictures with every pixel moved along the curve by the golden section of its length."""
    p, rows = _completed(spark, sf_dir)
    moved = ops.scramble(p, 64, rows)
    return moved.select((F.col("y") % 64).alias("y"), "x", F.floor(F.col("y") / 64).alias("image"), "v")


# --- sets, sums, reports -----------------------------------------------------------------------------------------


@query("SELECT user_id, array_to_string(list(v ORDER BY first), ',') AS found FROM (SELECT user_id, CAST(floor(value / 10) AS INT) AS v, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def scan_union(spark, sf_dir):
    """What several scans found, each once, in the order it was seen first."""
    once = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("value") / 10).cast("int").alias("v")).agg(F.min("event_id").alias("first"))
    return once.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "v"))), lambda x: x["v"].cast("string")), ",").alias("found"))


@query("SELECT min(path) AS root, count(*) AS spellings FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS path FROM part) GROUP BY lower(path)")
def distinct_roots(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    return table(spark, sf_dir, "part").select(path.alias("path")).groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("root"), F.count("*").alias("spellings")).drop("k")


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def invalid_keys(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).join(known, "key", "left_anti").distinct()


@query("SELECT conv_id, list_sort(list(coalesce(text, '')) FILTER (WHERE turn % 2 = 0)) IS NOT DISTINCT FROM list_sort(list(coalesce(text, '')) FILTER (WHERE turn % 2 = 1)) AS same FROM conversations GROUP BY conv_id")
def payload_multisets(spark, sf_dir):
    """Whether two sets of decoded texts are equal with their repeats, compared by counts: no list is built."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.coalesce("text", L("")).alias("text"), (F.col("turn") % 2).alias("side"))
    by_text = t.groupBy("conv_id", F.sha2("text", 256).alias("h")).agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("d"))
    return by_text.groupBy("conv_id").agg((F.max(F.abs("d")) == 0).alias("same"))


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS joined, count(*) AS parts FROM events GROUP BY user_id")
def concatenation(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("p"))
    return e.select("user_id", F.array_join(F.transform("p", lambda x: x["event_type"]), "").alias("joined"), F.size("p").cast("long").alias("parts"))


@query("SELECT event_type, count(*) FILTER (WHERE value <= 90) AS done, count(*) FILTER (WHERE value > 90) AS failed, count(*) FILTER (WHERE value > 90) = 0 AS clean FROM events GROUP BY event_type")
def batch_counts(spark, sf_dir):
    ok = F.col("value") <= 90
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"), (F.count_if(~ok) == 0).alias("clean"))


@query("""WITH b AS (SELECT page_id, unnest(range(1, octet_length(encode(url)) + 1)) AS i, octet_length(encode(url)) AS n, hex(encode(url)) AS h FROM pages),
v AS (SELECT page_id, n, i, CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS d FROM b),
s AS (SELECT page_id, CAST((1 + sum(d)) % 65521 + (any_value(n) + sum((n - i + 1) * d)) % 65521 * 65536 AS BIGINT) AS adler FROM v GROUP BY page_id)
SELECT page_id, CASE WHEN url IS NOT NULL THEN coalesce(adler, 1) END AS adler FROM pages LEFT JOIN s USING (page_id)""")
def adler_32(spark, sf_dir):
    """Two sums over the bytes of each address: of the bytes, and of the first sum after each byte; nothing sums to 1."""
    byte = lambda h: F.conv(h, 16, 10).cast("long")
    step = lambda s, h: F.struct(((s["a"] + byte(h)) % 65521).alias("a"), ((s["b"] + s["a"] + byte(h)) % 65521).alias("b"))
    pairs = F.regexp_extract_all(F.hex(F.col("url").cast("binary")), L(".."), L(0))
    start = F.struct(L(1).cast("long").alias("a"), L(0).cast("long").alias("b"))
    return table(spark, sf_dir, "pages").select("page_id", F.aggregate(pairs, start, step, lambda s: s["b"] * 65536 + s["a"]).alias("adler"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '步数 Steps' WHEN 'view' THEN '种子 Seed' WHEN 'purchase' THEN 'CFG / Guidance' WHEN 'signup' THEN '降噪 Denoise' ELSE event_type END AS shown FROM events")
def parameter_names(spark, sf_dir):
    """Names of parameters as reports show them, of several spellings."""
    t, odd = F.col("event_type"), F.col("event_id") % 2 == 1
    name = F.when(t == "click", F.when(odd, "Steps").otherwise("steps")).when(t == "view", F.when(odd, "seed").otherwise("noise_seed")).when(t == "purchase", F.when(odd, "CFG scale").otherwise("guidance"))
    name = name.when(t == "signup", F.when(odd, "denoise").otherwise("Denoising strength")).otherwise(t)
    return table(spark, sf_dir, "events").select("event_id", reports.parameter_name(name).alias("shown"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (WHERE value > 50) = 0 THEN '' ELSE 'user ' || user_id || chr(10) || string_agg(event_type || ': ' || event_id, chr(10) ORDER BY event_id) FILTER (WHERE value > 50) || chr(10) END AS report FROM events GROUP BY user_id""")
def text_reports(spark, sf_dir):
    """A text for each user; names without a value are left out, and so are users with none."""
    value = F.when(F.col("value") > 50, F.col("event_id").cast("string")).otherwise(" ")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.col("event_type").alias("name"), value.alias("value")))).alias("v"))
    return e.select("user_id", reports.text_report(F.concat(L("user "), F.col("user_id").cast("string")), F.col("v")).alias("report"))


@query("""SELECT p_partkey, '{"name":' || to_json(p_name) || ',"size":' || p_size || ',"fields":[{"name":"brand","value":' || to_json(p_brand) || '}]}' AS report FROM part""")
def json_reports(spark, sf_dir):
    made = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array(F.struct(L("brand").alias("name"), F.col("p_brand").alias("value"))).alias("fields")))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("report"))


@query("""SELECT event_id, '{"event":"' || event_type || '","file":"' || user_id || '","bytes":' || CAST(floor(value * 100) AS BIGINT) || '}' AS line FROM events""")
def event_lines(spark, sf_dir):
    """Events as lines of JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("file"), F.floor(F.col("value") * 100).alias("bytes"))).alias("line"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp FROM orders")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("""SELECT doc_id, instr(positive, '{prompt}') > 0 AND (negative = '' OR instr(negative, '{negative}') > 0) AND steps BETWEEN 0 AND 80 AND scale BETWEEN 0 AND 20 AS ok FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text ELSE text || ' {prompt}' END AS positive, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{negative}' ELSE 'none' END AS negative, n_chars % 100 AS steps, n_chars % 25 AS scale FROM documents)""")
def profile_validation(spark, sf_dir):
    """Templates that keep their tokens, and numbers within bounds."""
    k, head = F.col("doc_id"), F.col("text")
    positive = F.when(k % 4 == 0, head).otherwise(F.concat(head, L(" {prompt}")))
    negative = F.when(k % 3 == 0, "").when(k % 3 == 1, "{negative}").otherwise("none")
    ok = F.contains(positive, L("{prompt}")) & ((negative == "") | F.contains(negative, L("{negative}"))) & (F.col("n_chars") % 100).between(0, 80) & (F.col("n_chars") % 25).between(0, 20)
    return table(spark, sf_dir, "documents").select("doc_id", ok.alias("ok"))


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'picture' ELSE s END || '_clean.png' AS name FROM (SELECT doc_id, rtrim(left(rtrim(trim(regexp_replace(left(coalesce(text, ''), 90), '[\x00-\x1F<>:\x22/\\|?*]', '_', 'g')), '.'), 70)) AS s FROM documents)")
def output_stems(spark, sf_dir):
    """File names out of texts: nothing a file system refuses, 70 characters at most."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(naming.stem(F.left(F.coalesce("text", L("")), L(90))), L("_clean.png")).alias("name"))


# --- frames ------------------------------------------------------------------------------------------------------

MS = "epoch_us(ts) // 1000"


@query(f"SELECT user_id, ({MS}) // 160 AS tick, arg_max(event_id, [{MS}, event_id]) AS event_id, arg_max(event_type, [{MS}, event_id]) AS event_type, count(*) AS frames FROM events GROUP BY 1, 2")
def newest_frames(spark, sf_dir):
    return frames.newest(table(spark, sf_dir, "events"))


def _timed(spark, sf_dir, after=False):
    """Events with their milliseconds and those of the one before (or after) of the same user, by days: no window holds a user."""
    e = table(spark, sf_dir, "events").withColumns({"ms": frames.milliseconds(F.col("ts")), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    return beside(e, "user_id", "us", ["event_id"], 86_400_000_000, F.col("ms"), "beside", after)


@query(f"SELECT event_id, coalesce(lead({MS}) OVER w - ({MS}) > 150, true) AS shown FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def debounced_requests(spark, sf_dir):
    """A request is carried out if none follows within 150 ms."""
    e = _timed(spark, sf_dir, after=True)
    return e.select("event_id", F.coalesce(F.col("beside") - F.col("ms") > 150, L(True)).alias("shown"))


@query(f"SELECT event_id, user_id, ({MS}) - before AS waited FROM (SELECT *, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS before FROM events) WHERE ({MS}) - before > 10000")
def silent_devices(spark, sf_dir):
    """Where more than ten seconds went by without a frame."""
    e = _timed(spark, sf_dir)
    waited = F.col("ms") - F.col("beside")
    return e.select("event_id", "user_id", waited.alias("waited")).where("waited > 10000")


@query("SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS match, count(*) FILTER (WHERE event_id <= coalesce(first, event_id)) AS looked_at FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY user_id")
def first_match(spark, sf_dir):
    """The first match of each device and how many frames were looked at until then."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("match"))
    looked = F.count_if(F.col("event_id") <= F.coalesce("match", "event_id")).alias("looked_at")
    return e.join(first, "user_id").groupBy("user_id", "match").agg(looked)


@query(f"SELECT event_id, round(CASE WHEN ms - before >= 400 THEN (value * 1000) / ((ms - before) / 1000.0::DOUBLE) END, 6) AS speed FROM (SELECT *, {MS} AS ms, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS before FROM events)")
def transfer_speed(spark, sf_dir):
    """Bytes a second since the report before, where at least 0.4 s went by."""
    e = _timed(spark, sf_dir)
    gone = F.col("ms") - F.col("beside")
    told = e.select("event_id", "value", gone.alias("gone"))
    return told.select("event_id", F.round(F.when(F.col("gone") >= 400, F.col("value") * 1000 / (F.col("gone") / L(1000.0))), 6).alias("speed"))


# --- more files and graphs ---------------------------------------------------------------------------------------


def _little(n):
    """A number below 2^31 in little-endian hex of four bytes."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def _low(n, width):
    """A number below 65536 in little-endian hex of so many bytes."""
    return F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"), L("00" * (width - 2)))


@query("""SELECT doc_id, '1a45dfa38468656164' || '18538067ff' || '1549a966aa' || 'eca1' || repeat('00', 33) || '44898464757261' || CASE WHEN doc_id % 2 = 0 THEN 'eca3' || repeat('00', 35) ELSE '' END || '1f43b67590' || md5(text) AS cleaned FROM documents""")
def ebml_clean(spark, sf_dir):
    """A title and tags become filler of their length; a length in seconds and the frames stay."""
    digest = F.md5("text")
    info = F.concat(L(b"\x15\x49\xa9\x66\xaa\x7b\xa9\xa0"), digest.cast("binary"), L(b"\x44\x89\x84dura"))
    tags = F.when(F.col("doc_id") % 2 == 0, F.concat(L(b"\x12\x54\xc3\x67\xa0"), digest.cast("binary"))).otherwise(L(b""))
    film = F.concat(L(b"\x1a\x45\xdf\xa3\x84head\x18\x53\x80\x67\xff"), info, tags, L(b"\x1f\x43\xb6\x75\x90"), F.unhex(digest))
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(cleaners.ebml_without_notes(film))).alias("cleaned"))


@query("SELECT doc_id, doc_id % 5 IN (0, 4) AS ok FROM documents")
def rar_check(spark, sf_dir):
    """Archives whole, cut inside a header, of several volumes, with a wrong checksum, and with bytes behind their end."""
    kind, text = F.col("doc_id") % 5, F.coalesce("text", L("")).cast("binary")

    def block(of, flags, rest, data=L(b"")):
        body = F.concat(L(bytes([of])), F.unhex(_low(flags, 2)), F.unhex(_low(F.octet_length(rest) + 7, 2)), rest)
        sum_ = F.crc32(body) % 65536
        return F.concat(F.unhex(_low(F.when((kind == 3) & L(of == 0x74), (sum_ + 1) % 65536).otherwise(sum_), 2)), body, data)

    main = block(0x73, F.when(kind == 2, 1).otherwise(0), L(bytes(6)))
    file = block(0x74, L(0x8000), F.concat(F.unhex(_little(F.octet_length(text))), L(bytes(21))), text)
    whole = F.concat(L(b"Rar!\x1a\7\0"), main, file, block(0x7B, L(0), L(b"")), F.when(kind == 4, L(b"more")).otherwise(L(b"")))
    cut = F.when(kind == 1, F.substring(whole, 1, 30)).otherwise(whole)
    return table(spark, sf_dir, "documents").select("doc_id", cleaners.valid_rar(cut).alias("ok"))


_orientation = by_row(validators.orientation, IntegerType())


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 9 BETWEEN 1 AND 8 THEN doc_id % 9 ELSE 1 END AS INT) AS turned FROM documents")
def exif_orientation(spark, sf_dir):
    """The orientation of EXIF blocks of either order of bytes; 1 where it is none of the eight."""
    return table(spark, sf_dir, "documents").select("doc_id", _orientation(_exif(F.col("doc_id") % 9)).alias("turned"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'yes ' || turn ELSE 'no ' || turn END AS positive, CASE WHEN conv_id % 2 = 0 THEN 'no ' || turn ELSE 'yes ' || turn END AS negative FROM conversations""")
def enriched_graphs(spark, sf_dir):
    """Executed graphs of a node that only the saved graph tells the outputs of, in either order; stale widgets don't count."""
    n = F.col("turn").cast("string")
    dual = F.struct(L("UnknownDual").alias("class_type"), F.struct(F.concat(L("yes "), n).alias("positive"), F.concat(L("no "), n).alias("negative")).alias("inputs"))
    slot = lambda i: F.array(L("1"), L(i))
    end = F.struct(L("KSampler").alias("class_type"), F.struct(slot("0").alias("positive"), slot("1").alias("negative"), L(20).alias("steps"), L(7).alias("cfg"), L(1).alias("seed")).alias("inputs"))
    executed = F.concat(L('{"1":'), F.to_json(dual), L(',"2":'), F.to_json(end), L("}"))
    names = F.when(F.col("conv_id") % 2 == 0, L('[{"name":"positive"},{"name":"negative"}]')).otherwise(L('[{"name":"negative"},{"name":"positive"}]'))
    saved = F.concat(L('{"nodes":[{"id":1,"type":"UnknownDual","widgets_values":{"positive":"stale"},"outputs":'), names, L("}]}"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", graphs.samplers(executed, saved)[0].alias("s"))
    return c.select("conv_id", "turn", "s.positive", "s.negative")


@query("SELECT conv_id, turn, coalesce(text, '') AS positive, 'never ' || coalesce(role, '') AS negative, CAST(4 AS INT) AS upstream FROM conversations")
def saved_graphs(spark, sf_dir):
    """Saved graphs alone: links of both forms, widgets by place, by name, and a single text."""
    widget = lambda c: F.to_json(F.array(c))
    negative = F.to_json(F.struct(F.concat(L("never "), F.coalesce("role", L(""))).alias("text")))
    graph = F.concat(
        L('{"nodes":[{"id":1,"type":"UserLiteral","widgets_values":'), widget(F.coalesce("text", L(""))), L(',"outputs":[{"name":"STRING","type":"STRING"}]},{"id":2,"type":"CustomEncoder","widgets_values":'), negative,
        L('},{"id":3,"type":"CLIPTextEncode","inputs":[{"name":"text","link":1}]},{"id":4,"type":"KSampler","widgets_values":[5,"fixed",20,7,"euler","normal",1],"inputs":[{"name":"positive","link":2},{"name":"negative","link":3}]}],'),
        L('"links":[{"id":1,"origin_id":1,"origin_slot":0,"target_id":3},[2,3,0,4,0,"CONDITIONING"],[3,2,0,4,1,"CONDITIONING"]]}'),
    )
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", graphs.samplers(L(None).cast("string"), graph)[0].alias("s"))
    return c.select("conv_id", "turn", "s.positive", "s.negative", "s.upstream")


@query(r"""SELECT page_id, regexp_matches(u, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s@]+(:[0-9]+)?([/?#]\S*)?$') AS web, regexp_extract(u, '^[A-Za-z]+://([^/?#:@\s]+@)?([^/?#:@\s]+)', 2) AS host, regexp_matches(u, '^[A-Za-z]+://[^/?#\s]*@') AS with_user
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://joe@') WHEN 1 THEN upper(left(url, 5)) || substr(url, 6) WHEN 2 THEN 'ftp' || substr(url, position(':' IN url)) WHEN 3 THEN url || ' x' ELSE url END AS u FROM pages)""")
def url_parts(spark, sf_dir):
    """Whether an address is of the web and names no user, and its host."""
    k, url = F.col("page_id") % 5, F.col("url")
    u = F.when(k == 0, F.replace(url, L("://"), L("://joe@"))).when(k == 1, F.concat(F.upper(F.left(url, L(5))), F.expr("substring(url, 6)")))
    u = u.when(k == 2, F.concat(L("ftp"), F.expr("substring(url, instr(url, ':'))"))).when(k == 3, F.concat(url, L(" x"))).otherwise(url)
    p = table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    web = F.col("u").rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s@]+(:[0-9]+)?([/?#]\S*)?\z")
    return p.select("page_id", web.alias("web"), F.regexp_extract("u", r"^[A-Za-z]+://([^/?#:@\s]+@)?([^/?#:@\s]+)", 2).alias("host"), F.col("u").rlike(r"^[A-Za-z]+://[^/?#\s]*@").alias("with_user"))


@query("""WITH m AS (SELECT n_nationkey AS package, n_regionkey % 3 AS family, n_name FROM nation), f AS (SELECT package, family, n_name, unnest(range(3)) AS k FROM m WHERE family IN (1, 2))
SELECT package, n_name || '/' || k || CASE WHEN k = 0 THEN '.safetensors' ELSE '.json' END AS path, (package + 1) * 100 + k AS size FROM f WHERE NOT (package % 4 = 0 AND k = 0)""")
def manifest_files(spark, sf_dir):
    """A manifest in JSON, opened into the files of one family and of all families, without weights where these are given."""
    n = table(spark, sf_dir, "nation")
    file = lambda k: F.struct(F.concat("n_name", L(f"/{k}{'.safetensors' if k == 0 else '.json'}")).alias("path"), ((F.col("n_nationkey") + 1) * 100 + k).alias("size"))
    written = F.to_json(F.struct(F.col("n_nationkey").alias("package"), (F.col("n_regionkey") % 3).alias("family"), F.array(*[file(k) for k in range(3)]).alias("files")))
    m = n.select(F.from_json(written, "package int, family int, files array<struct<path:string,size:int>>").alias("m")).select("m.*").where(F.col("family").isin(1, 2))
    return m.select("package", F.explode("files").alias("f")).select("package", "f.path", "f.size").where(~((F.col("package") % 4 == 0) & F.col("path").endswith(".safetensors")))
