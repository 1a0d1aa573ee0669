"""What private chunks of a picture say, as expressions over its chunk list (`containers.CHUNKS`): none needs a pixel.

Fixed values: type names, the places of fields in their data, and the bounds of each.
Cases: a null list, as of a file that can't be read, says nothing (null); of several chunks of a type the first counts; data of
another size than a chunk's own, a wrong check sum and a field out of bounds make a chunk wrong.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "Url string, X long, Y long, Size long, Width long, Height long, Margin long, Raw boolean"


def first(chunks: Column, kind: str) -> Column:
    """The first chunk of a type, or null."""
    return F.get(F.filter(chunks, lambda c: c["type"] == kind), 0)


def byte(data: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")


def number(data: Column, at: int) -> Column:
    """Four bytes, the highest first."""
    return F.conv(F.hex(F.substring(data, at + 1, 4)), 16, 10).cast("long")


def background(chunks: Column) -> tuple[Column, Column]:
    """What two pictures in one were made against: a verdict (`black` without a chunk that tells, as of older files; `size` and
    `wrong` for chunks that can't be used; `told`), and the gray value."""
    c = first(chunks, "duAL")
    data = c["data"]
    b = [byte(data, i) for i in range(4)]
    good = c["crc_ok"] & (b[0] == 1) & b[1].between(1, 2) & (b[2] <= 128) & (b[3] <= 100)
    verdict = F.when(chunks.isNull(), None).when(c.isNull(), "black").when(F.octet_length(data) != 4, "size").when(good, "told").otherwise("wrong")
    return verdict, F.when(verdict == "black", 0).when(verdict == "told", b[2])


def is_dual(chunks: Column) -> Column:
    """Whether a picture can hold two: it does not move, and says so or has an alpha channel or a transparent colour."""
    alpha = byte(first(chunks, "IHDR")["data"], 9).isin(4, 6)
    there = lambda kind: first(chunks, kind).isNotNull()
    return F.when(chunks.isNotNull(), ~there("acTL") & (there("duAL") | F.coalesce(alpha, F.lit(False)) | there("tRNS")))


def reveal(chunks: Column) -> Column:
    """How a hidden picture was made: a struct of mode, color, strength and the tint's three parts; null if no chunk says so rightly."""
    c = first(chunks, "rvAO")
    data = c["data"]
    b = [byte(data, i) for i in range(7)]
    good = c["crc_ok"] & (F.octet_length(data) == 7) & (b[0] == 1) & b[1].between(1, 3) & b[2].between(0, 1) & (b[3] <= 100)
    mode = F.element_at(F.array(*map(F.lit, ("plain", "theme", "source"))), b[1])
    told = F.struct(mode.alias("mode"), (b[2] == 1).alias("color"), b[3].alias("strength"), *[(b[4 + i] - 128).alias(n) for i, n in enumerate(("red", "green", "blue"))])
    return F.when(good, told)


def code_tag(chunks: Column, most: int = 8192) -> Column:
    """Where a picture says that its code is: the record as a struct of TAG; null where it does not fit the picture."""
    head, c = first(chunks, "IHDR")["data"], first(chunks, "qrLK")
    t = F.from_json(c["data"].cast("string"), TAG)
    width, height = number(head, 0), number(head, 4)
    fits = (t["Width"] == width) & (t["Height"] == height) & width.between(1, 8192) & height.between(1, 8192)
    inside = (t["Size"] >= 1) & (t["X"] >= 0) & (t["Y"] >= 0) & (t["X"] + t["Size"] <= width) & (t["Y"] + t["Size"] <= height)
    good = c["crc_ok"] & (F.octet_length(c["data"]) <= most) & t["Margin"].between(0, 12) & (F.length(t["Url"]) > 0) & fits & inside
    return F.when(F.coalesce(good, F.lit(False)), t)
