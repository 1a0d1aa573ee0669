"""Queries over files made of the tables: the order of chunks, tables that are published as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaners, containers, naming, private
from ..operators.automaton import PNG_ORDER, ends, kind_of
from ..sources.ordered import numbered_within
from ..sources.publish import current, published
from ..sources.tables import table
from .catalog import _kept_folder, query

#: A line's chunk by the first byte of its digest, of 32: up to which, and the type.
KINDS = ((20, "IDAT"), (27, "tEXt"), (29, "aiMd"), (31, "aiPd"), (32, "acTL"))


def _number(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def _chunk(kind: Column, data: Column, damaged: Column | None = None) -> Column:
    """A chunk as bytes: size, type, data, check sum, which is one too large in a damaged one."""
    body = F.concat(kind.cast("binary"), data.cast("binary"))
    total = F.crc32(body) if damaged is None else F.when(damaged, (F.crc32(body) + 1) % (1 << 32)).otherwise(F.crc32(body))
    return F.concat(_number(F.octet_length(data).cast("long")), body, _number(total))


_MOVES = ", ".join(f"({i}, '{s}', {to[i]})" for s, to in PNG_ORDER.table().items() for i in range(len(PNG_ORDER.states)))
_NAMES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(PNG_ORDER.states))
_KIND_SQL = "CASE " + " ".join(f"WHEN m < {top} THEN '{'other' if k == 'tEXt' else k}'" for top, k in KINDS) + " END"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, {_KIND_SQL} AS kind FROM (SELECT doc_id, i, ('0x' || substr(md5(line), 1, 2))::INT % 32 AS m FROM l) UNION ALL SELECT doc_id, 0, 'IHDR' FROM documents WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, 1000000000, 'IEND' FROM documents),
c AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM k), mv(state, kind, went) AS (VALUES {_MOVES}), nm(state, name) AS (VALUES {_NAMES}),
r AS (SELECT doc_id, 0::BIGINT AS i, 0 AS state FROM documents UNION ALL SELECT r.doc_id, c.i, mv.went FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1 JOIN mv ON mv.state = r.state AND mv.kind = c.kind),
e AS (SELECT doc_id, max(i) AS n, arg_max(state, i) AS state FROM r GROUP BY doc_id) SELECT doc_id, name AS verdict, n AS chunks FROM e JOIN nm USING (state)""")
def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose chunks are the lines of a text: what the order of their chunks makes of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    m = lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 2), 16, 10).cast("int") % 32

    def kind(line: Column) -> Column:
        out = F.lit(KINDS[-1][1])
        for top, name in KINDS[-2::-1]:
            out = F.when(m(line) < top, name).otherwise(out)
        return out

    bodies = F.transform("lines", lambda x: _chunk(kind(x), x))
    head = F.when(F.col("doc_id") % 13 != 0, _chunk(F.lit("IHDR"), F.unhex(F.lit("00000001000000010800000000")))).otherwise(F.lit(b""))
    # all chunks one after the other; hex text is what arrays of bytes can be joined by
    middle = F.unhex(F.array_join(F.transform(bodies, F.hex), ""))
    files = docs.select("doc_id", F.concat(F.lit(containers.SIGNATURE), head, middle, _chunk(F.lit("IEND"), F.lit(""))).alias("png"))
    chunks = files.select("doc_id", F.explode(containers.png_chunks("png")).alias("c")).select("doc_id", "c.seq", kind_of(F.col("c.type")).alias("kind"))
    return ends(chunks, "doc_id", "seq", "kind", PNG_ORDER).select("doc_id", F.col("state").alias("verdict"), F.col("n").alias("chunks"))


@query("SELECT doc_id, sha256(text) AS sha256, source FROM documents WHERE lang = 'en'")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was published twice, as its readers see it: the second version, whole."""
    _kept_folder(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/published-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "source", "lang")
    published(docs.where("lang <> 'en'").drop("lang"), root)
    published(docs.where("lang = 'en'").drop("lang"), root)
    return current(spark, root)


# --- private chunks ----------------------------------------------------------------------------------------------

_M_SQL = "m AS (SELECT doc_id, list_transform(range(16), lambda i: ('0x' || substr(md5(coalesce(text, '')), 2 * i + 1, 2))::INT) AS m FROM documents)"


def _files(docs: DataFrame) -> DataFrame:
    """(doc_id, chunks): pictures with private chunks, each field and each damage by a byte of the digest of a text."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    m = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") for i in range(16)]
    data = lambda *bs: F.unhex(F.concat(*[F.lpad(F.hex(b.cast("long")), 2, "0") for b in bs]))
    lit, nothing = F.lit, F.lit(b"")
    colour = F.element_at(F.array(*map(lit, (0, 2, 3, 4, 6))), m[0] % 5 + 1)
    head = F.concat(_number(lit(7).cast("long")), _number(lit(5).cast("long")), data(lit(8), colour, lit(0), lit(0), lit(0)))
    told = data(F.when(m[4] < 230, 1).otherwise(2), m[5] % 4, m[6] % 160, m[7] % 120)
    told = F.when(m[8] < 10, F.concat(told, lit(b"!"))).otherwise(told)
    made = data(lit(1), 1 + m[11] % 4, m[12] % 2, m[13] % 120, m[14], m[15], m[0])
    parts = [
        lit(containers.SIGNATURE), _chunk(lit("IHDR"), head),
        F.when(m[3] < 200, _chunk(lit("duAL"), told, m[9] < 20)).otherwise(nothing), F.when((m[3] < 200) & (m[10] < 128), _chunk(lit("rvAO"), made)).otherwise(nothing),
        F.when(m[1] < 64, _chunk(lit("tRNS"), lit("t"))).otherwise(nothing), F.when(m[2] < 32, _chunk(lit("acTL"), lit("a"))).otherwise(nothing),
        _chunk(lit("IDAT"), lit("d")), _chunk(lit("IEND"), lit("")),
    ]
    return docs.select("doc_id", F.concat(*parts).alias("png")).select("doc_id", containers.png_chunks("png").alias("chunks"))


@query(f"""WITH {_M_SQL}, f AS (SELECT doc_id, [0, 2, 3, 4, 6][m[1] % 5 + 1] AS colour, m[2] < 64 AS trns, m[3] < 32 AS moves, m[4] < 200 AS dual, m[9] < 10 AS long, m[10] < 20 AS damaged, CASE WHEN m[5] < 230 THEN 1 ELSE 2 END AS b0, m[6] % 4 AS b1, m[7] % 160 AS b2, m[8] % 120 AS b3 FROM m),
v AS (SELECT *, CASE WHEN NOT dual THEN 'black' WHEN long THEN 'size' WHEN damaged OR b0 <> 1 OR b1 NOT BETWEEN 1 AND 2 OR b2 > 128 OR b3 > 100 THEN 'wrong' ELSE 'told' END AS verdict FROM f)
SELECT doc_id, verdict, CASE verdict WHEN 'black' THEN 0 WHEN 'told' THEN b2 END AS ground, NOT moves AND (dual OR colour IN (4, 6) OR trns) AS dual FROM v""")
def background_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pictures' own chunks say of the ground two of them were made against, and whether they hold two."""
    c = F.col("chunks")
    verdict, ground = private.background(c)
    return _files(table(spark, sf_dir, "documents")).select("doc_id", verdict.alias("verdict"), ground.alias("ground"), private.is_dual(c).alias("dual"))


@query(f"""WITH {_M_SQL} SELECT doc_id, ['plain', 'theme', 'source'][1 + m[12] % 4] AS mode, m[13] % 2 = 1 AS color, m[14] % 120 AS strength, m[15] - 128 AS red, m[16] - 128 AS green, m[1] - 128 AS blue FROM m WHERE m[4] < 200 AND m[11] < 128 AND m[12] % 4 < 3 AND m[14] % 120 <= 100""")
def reveal_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How hidden pictures were made, of those that say so."""
    told = _files(table(spark, sf_dir, "documents")).select("doc_id", private.reveal(F.col("chunks")).alias("r")).where("r IS NOT NULL")
    return told.select("doc_id", "r.*")


@query("""WITH m AS (SELECT page_id, url, list_transform(range(8), lambda i: ('0x' || substr(md5(url), 2 * i + 1, 2))::INT) AS m FROM pages WHERE url IS NOT NULL),
f AS (SELECT page_id, url, 100 + m[1] AS w, 100 + m[2] AS h, m[3] AS x, m[4] AS y, m[5] % 120 AS size, m[6] % 16 AS margin, m[7] < 20 AS damaged, m[8] < 20 AS other FROM m)
SELECT page_id, url, x, y, size, margin FROM f WHERE NOT damaged AND NOT other AND margin <= 12 AND size >= 1 AND x + size <= w AND y + size <= h AND url <> '' AND octet_length(encode(url)) <= 7900""")
def code_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pictures say that their codes are, of those whose records fit them."""
    digest = F.md5(F.col("url").cast("binary"))
    m = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") for i in range(8)]
    w, h = 100 + m[0], 100 + m[1]
    record = F.to_json(F.struct(F.col("url").alias("Url"), m[2].alias("X"), m[3].alias("Y"), (m[4] % 120).alias("Size"), F.when(m[7] < 20, w + 1).otherwise(w).alias("Width"), h.alias("Height"), (m[5] % 16).alias("Margin"), F.lit(False).alias("Raw")))
    head = F.concat(_number(w.cast("long")), _number(h.cast("long")), F.unhex(F.lit("0800000000")))
    png = F.concat(F.lit(containers.SIGNATURE), _chunk(F.lit("IHDR"), head), _chunk(F.lit("IDAT"), F.lit("d")), _chunk(F.lit("qrLK"), record, m[6] < 20), _chunk(F.lit("IEND"), F.lit("")))
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    found = pages.select("page_id", png.alias("png")).select("page_id", private.code_tag(containers.png_chunks("png")).alias("t")).where("t IS NOT NULL")
    return found.select("page_id", F.col("t.Url").alias("url"), *[F.col(f"t.{n}").cast("int").alias(n.lower()) for n in ("X", "Y", "Size", "Margin")])


_SIZE_SQL = "8 + 25 + 13 + 12 + CASE WHEN trns THEN 13 ELSE 0 END + CASE WHEN moves THEN 13 ELSE 0 END"


@query(f"""WITH {_M_SQL}, f AS (SELECT doc_id, m[2] < 64 AS trns, m[3] < 32 AS moves, m[4] < 200 AS dual, m[4] < 200 AND m[11] < 128 AS made, m[9] < 10 AS long FROM m),
s AS (SELECT *, {_SIZE_SQL} AS kept, CASE WHEN dual THEN CASE WHEN long THEN 17 ELSE 16 END ELSE 0 END + CASE WHEN made THEN 19 ELSE 0 END AS gone FROM f)
SELECT doc_id, 3 + trns::INT + moves::INT + dual::INT + made::INT AS chunks, CASE WHEN moves THEN 'animated' ELSE 'picture' END AS verdict, concat_ws(',', CASE WHEN dual THEN 'duAL' END, CASE WHEN made THEN 'rvAO' END) AS dropped, (kept + gone)::BIGINT AS bytes, kept::BIGINT AS clean_bytes, NOT moves AS keeps_order FROM s""")
def inspection_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One look at each picture: its chunks and the verdict on their order, which of them go when it is cleaned, its size before
    and after, and whether what is left is a picture in order: listing, cleaning and checking over the same rows."""
    _kept_folder(spark)
    listed = _files(table(spark, sf_dir, "documents")).checkpoint()  # the codec reads each file once
    chunks = listed.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.seq", "c.type", kind_of(F.col("c.type")).alias("kind"), F.octet_length("c.data").alias("n"))
    chunks = chunks.withColumn("stays", F.col("type").isin(*[t.decode() if isinstance(t, bytes) else t for t in cleaners.PNG_KEPT]))
    size = lambda c: F.sum(F.when(c, F.col("n") + 12).otherwise(0))
    gone = F.array_join(F.sort_array(F.collect_set(F.when(~F.col("stays"), F.col("type")))), ",")
    told = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"), gone.alias("dropped"), (size(F.lit(True)) + 8).alias("bytes"), (size(F.col("stays")) + 8).alias("clean_bytes"))
    before = ends(chunks, "doc_id", "seq", "kind", PNG_ORDER).select("doc_id", F.col("state").alias("verdict"))
    after = ends(chunks.where("stays"), "doc_id", "seq", "kind", PNG_ORDER).select("doc_id", (F.col("state") == "picture").alias("keeps_order"))
    return told.join(before, "doc_id").join(after, "doc_id").select("doc_id", "chunks", "verdict", "dropped", "bytes", "clean_bytes", "keeps_order")


@query(r"""WITH s AS (SELECT doc_id, CASE WHEN s = '' THEN 'picture' ELSE s END AS stem FROM (SELECT doc_id, rtrim(left(rtrim(trim(regexp_replace(left(coalesce(lang || ':' || source, ''), 90), '[\x00-\x1F<>:\x22/\\|?*]', '_', 'g')), '.'), 70)) AS s FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS n FROM s) SELECT doc_id, stem || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.png' AS name FROM n""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that a file system takes, each once: what it refuses is replaced, and names met before are numbered."""
    wanted = F.coalesce(F.concat("lang", F.lit(":"), "source"), F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", naming.stem(F.left(wanted, F.lit(90))).alias("stem"))
    n = numbered_within(d, "stem", "doc_id", [], 100_000, "n")
    return n.select("doc_id", F.concat("stem", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string"))), F.lit(".png")).alias("name"))
