"""Byte-level codecs as row functions: PNG chunk lists and tail records."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import by_row

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNKS = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("crc_ok", T.BooleanType())]))
TAIL = b"QGRDTAIL"


def png_bytes(text: str) -> bytes:
    """A 1x1 gray PNG that carries the text in a compressed international text chunk."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"text\0\1\0\0\0" + zlib.compress(text.encode(), 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"iTXt", body) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def chunk_list(content: bytes | None) -> list[dict] | None:
    """The chunks of a PNG; None if it is cut short, unsigned or does not end in IEND."""
    if not content or not content.startswith(SIGNATURE):
        return None
    at, out = 8, []
    while at + 12 <= len(content):
        size = int.from_bytes(content[at : at + 4], "big")
        if at + 12 + size > len(content):
            return None
        kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        crc = int.from_bytes(content[at + 8 + size : at + 12 + size], "big")
        out.append({"seq": len(out), "type": kind.decode("latin-1"), "data": data, "crc_ok": crc == zlib.crc32(kind + data)})
        at += 12 + size
        if kind == b"IEND":
            return out if at == len(content) else None
    return None


def itxt(data: bytes | None) -> str | None:
    return zlib.decompress(data.split(b"\0", 1)[1][4:]).decode() if data is not None else None


to_png = by_row(lambda text: png_bytes(text or ""), T.BinaryType())
png_chunks = by_row(chunk_list, CHUNKS)
itxt_text = by_row(itxt, T.StringType())


def with_tail(content, record):  # noqa: ANN001, ANN201
    """Bytes followed by a record, its length (8 hex digits) and a magic, with built-in functions only."""
    data = record.cast("binary")
    return F.concat(content, data, F.lpad(F.hex(F.octet_length(data)), 8, "0").cast("binary"), F.lit(TAIL))


def tail_of(content):  # noqa: ANN001, ANN201
    """The record behind the content, or null without magic or with a length that doesn't fit."""
    n = F.octet_length(content)
    size = F.conv(F.substring(content, n - 15, 8).cast("string"), 16, 10).try_cast("int")
    ok = (n >= 16) & (F.substring(content, n - 7, F.lit(8)) == F.lit(TAIL)) & (size <= n - 16)
    return F.when(ok, F.substring(content, n - 15 - size, size).cast("string"))
