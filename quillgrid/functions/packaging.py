"""Files carried inside pictures, and back: behind the picture (PNG chunks, a JPEG record, plain concatenation) with the
length and hash checked. ZIP archives have their offsets moved, so that they open from the picture as well.
"""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import types as T

from .cleaners import check_rar, png_of
from .containers import SIGNATURE, chunk_list
from .rows import by_row
from .validators import ZIP64_END, ZIP64_LOCATOR, ZIP_END, ZIP_ENTRY, check_7z, check_mp4, check_zip, cleaned, jpeg_segments, judged, need

# Chunk names of record and file, the JPEG record's marker and magic, limits.
RECORD, PAYLOAD, JPEG_RECORD, JPEG_MAGIC = "aiMd", "aiPd", 0xEF, b"AIPTFILE1\0"
MOST_RECORD = 2048
CHECKS = {"zip": check_zip, "7z": check_7z, "mp4": check_mp4, "rar": check_rar}
NONE32 = 0xFFFFFFFF


def kind_of(data: bytes) -> str | None:
    """The kind a file's first bytes say and its check confirms."""
    sign = {b"PK": "zip", b"Ra": "rar", b"7z": "7z"}.get(data[:2], "mp4" if data[4:8] == b"ftyp" else None)
    return sign if sign and judged(CHECKS[sign])(data) else None


def moved_zip(data: bytes, delta: int) -> bytes:
    """A checked archive with all its offsets moved by `delta`; those that are negative or leave 32 bits are refused."""
    out, base = bytearray(data), max(0, -delta)
    end = data.rfind(ZIP_END)
    need(end >= 0)
    moves: list[tuple[int, str]] = []
    entries, at = struct.unpack_from("<10xH4xI", data, end)
    if at != NONE32:
        moves.append((end + 16, "<I"))
    if data[end - 20 : end - 16] == ZIP64_LOCATOR and end >= 20:
        wide = struct.unpack_from("<Q", data, end - 12)[0] - base
        need(0 <= wide <= len(data) - 56 and data[wide : wide + 4] == ZIP64_END)
        entries, at = struct.unpack_from("<32xQ8xQ", data, wide)
        moves += [(end - 12, "<Q"), (wide + 48, "<Q")]
    at -= base
    for _ in range(entries):
        need(data[at : at + 4] == ZIP_ENTRY)
        packed, whole, name, extra, note, local = struct.unpack_from("<20xIIHHH8xI", data, at)
        if local != NONE32:
            moves.append((at + 42, "<I"))
        else:
            p, stop, found = at + 46 + name, at + 46 + name + extra, False
            while p + 4 <= stop and not found:
                tag, size = struct.unpack_from("<HH", data, p)
                if found := tag == 1:
                    moves.append((p + 4 + 8 * ((whole == NONE32) + (packed == NONE32)), "<Q"))
                p += 4 + size
            need(found)
        at += 46 + name + extra + note
    for place, form in moves:
        value = struct.unpack_from(form, data, place)[0] + delta
        need(0 <= value < (NONE32 if form == "<I" else 1 << 63))
        struct.pack_into(form, out, place, value)
    return bytes(out)


def record(data: bytes, name: str, kind: str) -> bytes:
    made = json.dumps({"version": 1, "name": name, "kind": kind, "length": len(data), "sha256": hashlib.sha256(data).hexdigest()}).encode()
    need(len(made) <= MOST_RECORD)
    return made


def carried(data: bytes, kind: str, at: int) -> bytes:
    return moved_zip(data, at) if kind == "zip" else data


def restored(data: bytes, about: dict, at: int) -> tuple[str, bytes]:
    need(isinstance(about, dict) and about.get("length") == len(data))
    data = moved_zip(data, -at) if about["kind"] == "zip" else data
    need(hashlib.sha256(data).hexdigest() == about["sha256"])
    return about["name"], data


def pack_png(cover: bytes, data: bytes, name: str) -> bytes:
    kind, chunks = kind_of(data), chunk_list(cover)
    need(kind is not None and chunks is not None and not any(c["type"] in ("acTL", "fcTL", "fdAT", RECORD, PAYLOAD) for c in chunks))
    before = [(c["type"], c["data"]) for c in chunks[:-1]] + [(RECORD, record(data, name, kind))]
    at = len(png_of(before)) + 8
    return png_of([*before, (PAYLOAD, carried(data, kind, at)), ("IEND", b"")])


def pack_jpeg(cover: bytes, data: bytes, name: str) -> bytes:
    """The record as the first application segment, the file behind the picture."""
    kind = kind_of(data)
    need(kind is not None)
    picture = cover[: jpeg_segments(cover)[-1][2]]
    body = JPEG_MAGIC + record(data, name, kind)
    picture = picture[:2] + b"\xff" + bytes([JPEG_RECORD]) + struct.pack(">H", len(body) + 2) + body + picture[2:]
    return picture + carried(data, kind, len(picture))


def pack_behind(cover: bytes, data: bytes, name: str) -> bytes:
    """Picture and file as they are; nothing records what came in."""
    need(kind_of(data) is not None)
    return cover[: picture_end(cover)] + data


def picture_end(content: bytes) -> int:
    if content.startswith(SIGNATURE):
        at = 8
        while content[at + 4 : at + 8] != b"IEND":
            at += 12 + int.from_bytes(content[at : at + 4], "big")
            need(at + 12 <= len(content))
        return at + 12
    return jpeg_segments(content)[-1][2]


def unpack(content: bytes) -> tuple[str, bytes]:
    """(name, file); files that were only put behind a picture are named by their kind and must pass its check."""
    end = picture_end(content)
    if content.startswith(SIGNATURE):
        chunks = chunk_list(content[:end])
        need(chunks is not None and all(c["crc_ok"] for c in chunks))
        named = {c["type"]: c["data"] for c in chunks}
        if RECORD in named:
            need(PAYLOAD in named and [c["type"] for c in chunks[-3:]] == [RECORD, PAYLOAD, "IEND"])
            return restored(named[PAYLOAD], json.loads(named[RECORD]), end - 16 - len(named[PAYLOAD]))
    else:
        for marker, a, b in jpeg_segments(content):
            if marker == JPEG_RECORD and content[a + 4 : b].startswith(JPEG_MAGIC):
                return restored(content[end:], json.loads(content[a + 4 + len(JPEG_MAGIC) : b]), end)
    need((kind := kind_of(content[end:])) is not None)
    return f"restored.{kind}", content[end:]


PACKERS = {"png": pack_png, "jpeg": pack_jpeg, "behind": pack_behind}
FILE = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])


def packed_file(mode: str):  # noqa: ANN201
    """A column function of (cover, content, name): the picture that carries the file, or null where either is unfit."""

    def run(cover: bytes | None, content: bytes | None, name: str | None) -> bytes | None:
        return cleaned(lambda c: PACKERS[mode](c, content, name))(cover) if content is not None and name is not None else None

    return by_row(run, T.BinaryType())


def carried_file(content: bytes | None) -> tuple[str | None, bytes | None]:
    """Name and content, null where nothing is carried or a check fails."""
    try:
        return cleaned(unpack)(content) or (None, None)
    except (ValueError, KeyError):
        return None, None


unpacked_file = by_row(carried_file, FILE)
