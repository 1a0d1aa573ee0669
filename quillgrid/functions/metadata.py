"""Notes inside pictures: EXIF directories, and the text fields of PNG, JPEG and WebP as one map."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import types as T

from .cleaners import bare_exif, riff_parts
from .containers import SIGNATURE, chunk_list
from .rows import by_row
from .validators import Damaged, jpeg_segments, need

# Fixed values of the formats and limits.
SUB_DIRECTORY, USER_COMMENT, DESCRIPTION = 0x8769, 0x9286, 0x10E
MOST_DIRECTORIES, MOST_TEXT = 16, 16 * 1024 * 1024
BOMS = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
FIELDS = T.MapType(T.StringType(), T.StringType())


def exif_entries(tiff: bytes) -> list[tuple[int, int, bytes]]:
    """(tag, type, data) of the text-like entries in the order of a walk through the directories; what lies outside
    the block is passed over."""
    order, found, seen = {b"II": "<", b"MM": ">"}.get(tiff[:2]), [], set()
    if order is None or len(tiff) < 8:
        return found

    def walk(at: int) -> None:
        if at in seen or len(seen) >= MOST_DIRECTORIES or at > len(tiff) - 2:
            return
        seen.add(at)
        for i in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
            p = at + 2 + 12 * i
            if p + 12 > len(tiff):
                return
            tag, kind, count, value = struct.unpack_from(f"{order}HHII", tiff, p)
            if (tag, kind, count) == (SUB_DIRECTORY, 4, 1):
                walk(value)
            elif kind in (2, 7) and count <= MOST_TEXT:
                start = p + 8 if count <= 4 else value
                if start + count <= len(tiff):
                    found.append((tag, kind, tiff[start : start + count]))

    walk(struct.unpack_from(f"{order}I", tiff, 4)[0])
    return found


def user_comment(data: bytes) -> str:
    """Eight bytes name the encoding; UTF-16 without a byte order mark is big-endian."""
    body, coding = data[8:], "utf-8"
    if data.startswith(b"UNICODE"):
        coding = BOMS.get(body[:2], "utf-16-be")
        body = body[2:] if body[:2] in BOMS else body
    return body.decode(coding, "replace").rstrip("\0")


def exif_fields(block: bytes) -> list[tuple[str, str]]:
    fields = []
    for tag, _, data in exif_entries(bare_exif(block)):
        if tag == USER_COMMENT and len(data) >= 8:
            fields.append(("parameters", user_comment(data)))
            continue
        name, colon, rest = (text := data.decode("utf-8", "replace").rstrip("\0")).partition(":")
        if colon and name in ("prompt", "workflow"):
            fields.append((name, rest))
        elif tag == DESCRIPTION and "Steps:" in text:
            fields.append(("parameters", text))
    return fields


def inflated(data: bytes) -> bytes:
    need(len(data) >= 6 and not data[1] & 32)
    stream = zlib.decompressobj()
    out = stream.decompress(data, MOST_TEXT)
    need(not stream.unconsumed_tail and stream.eof)
    return out


def png_fields(kind: str, data: bytes) -> list[tuple[str, str]]:
    """The fields of one chunk. Damage inside a chunk loses that chunk alone."""
    try:
        if kind == "eXIf":
            return exif_fields(data)
        name, zero, rest = data.partition(b"\0")
        need(bool(zero))
        if kind == "zTXt":
            need(rest[:1] == b"\0")
            value = inflated(rest[1:]).decode("latin-1")
        elif kind == "iTXt":
            need(len(rest) >= 2 and rest[0] <= 1 and rest[1] == 0)
            language, keyword, body = rest[2:].split(b"\0", 2)
            value = (inflated(body) if rest[0] else body).decode("utf-8", "replace")
        else:
            value = rest.decode("latin-1")
        return [(name.decode("latin-1"), value)]
    except (Damaged, ValueError, zlib.error):
        return []


def text_fields(content: bytes | None) -> dict[str, str] | None:
    """Text fields by lower-case name, the last of a name kept; None for other formats and broken files."""
    try:
        if not content:
            return None
        if content.startswith(SIGNATURE):
            need((chunks := chunk_list(content)) is not None)
            found = [f for c in chunks if c["type"] in ("tEXt", "zTXt", "iTXt", "eXIf", "comf") for f in png_fields(c["type"], c["data"])]
        elif content[:2] == b"\xff\xd8":
            bodies = (content[content.index(bytes([m]), a + 1) + 3 : b] for m, a, b in jpeg_segments(content) if m == 0xE1)
            found = [f for body in bodies if body.startswith(b"Exif\0\0") for f in exif_fields(body)]
        else:
            found = [f for kind, data in riff_parts(content) if kind == b"EXIF" for f in exif_fields(data)]
    except (Damaged, struct.error, IndexError):
        return None
    return {name.lower(): value.rstrip("\0") for name, value in found}


picture_fields = by_row(text_fields, FIELDS)


def exif_of(text: str) -> bytes:
    """A block whose sub-directory has the text as a UTF-16 comment; for the queries over the driver tables."""
    data = b"UNICODE\0" + text.encode("utf-16-be", "replace")
    return struct.pack(">2sHIHHHIII", b"MM", 42, 8, 1, SUB_DIRECTORY, 4, 1, 26, 0) + struct.pack(">HHHIII", 1, USER_COMMENT, 7, max(5, len(data)), 44, 0) + data


def exif_webp(text: str | None) -> bytes:
    exif = exif_of(text or "")
    body = b"VP8L" + struct.pack("<I", 2) + b"\x2f\0" + b"EXIF" + struct.pack("<I", len(exif)) + exif + bytes(len(exif) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


to_exif_webp = by_row(exif_webp, T.BinaryType())
