"""Checks and cleaners of binary formats, one whole file in a row. All give None (or False) for damaged input.

Each format is first cut into segments; what a check accepts or a cleaner keeps is then a rule over the segments.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import by_row

# Fixed values of the formats.
ZIP_END, ZIP_ENTRY, ZIP_LOCAL, ZIP64_LOCATOR, ZIP64_END = b"PK\5\6", b"PK\1\2", b"PK\3\4", b"PK\6\7", b"PK\6\6"
SEVEN_ZIP = b"7z\xbc\xaf\x27\x1c"
DTYPE_BITS = {
    "F4": 4, "F6_E2M3": 6, "F6_E3M2": 6, "BOOL": 8, "U8": 8, "I8": 8, "F8_E5M2": 8, "F8_E4M3": 8, "F8_E8M0": 8,
    "I16": 16, "U16": 16, "F16": 16, "BF16": 16, "I32": 32, "U32": 32, "F32": 32, "I64": 64, "U64": 64, "F64": 64,
}
GIF_APPS = (b"NETSCAPE2.0", b"ANIMEXTS1.0")
JPEG_KEPT_APPS = {0xE0: b"JFIF\0", 0xEE: b"Adobe", 0xE2: b"ICC_PROFILE\0"}
MOST_BOXES, MOST_ENTRIES, MOST_HEADER = 100_000, 1_000_000, 100_000_000


class Damaged(ValueError):
    pass


def need(ok: bool) -> None:
    if not ok:
        raise Damaged


def judged(check: Callable[[bytes], object]) -> Callable[[bytes | None], bool]:
    """A check as a predicate: False where the format is broken."""

    def verdict(content: bytes | None) -> bool:
        try:
            return content is not None and check(content) is not False
        except (Damaged, struct.error, IndexError, UnicodeDecodeError):
            return False

    return verdict


def cleaned(clean: Callable[[bytes], bytes]) -> Callable[[bytes | None], bytes | None]:
    """A cleaner that gives None for a broken file."""

    def out(content: bytes | None) -> bytes | None:
        try:
            return None if content is None else clean(content)
        except (Damaged, struct.error, IndexError):
            return None

    return out


def mp4_boxes(content: bytes) -> list[tuple[bytes, int, int]]:
    """(type, start of the payload, end) of each top-level box; sizes of 64 bits and to the end of file are resolved."""
    at, boxes = 0, []
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", content, at + 8), 16
        elif size == 0:
            size = len(content) - at
        need(head <= size <= len(content) - at and len(boxes) < MOST_BOXES)
        boxes.append((kind, at + head, at + size))
        at += size
    return boxes


def check_mp4(content: bytes) -> bool:
    boxes = mp4_boxes(content)
    return {b"ftyp", b"moov", b"mdat"} <= {kind for kind, _, _ in boxes} and all(end - start >= 8 for kind, start, end in boxes if kind == b"ftyp")


def _wide(extra: bytes, wanted: list[bool]) -> list[int | None]:
    """The 64-bit numbers of a ZIP64 extra field for those of (size, packed, offset) that overflowed."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        need(at + 4 + size <= len(extra))
        if tag == 1:
            need(8 * sum(wanted) <= size)
            numbers = iter(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
            return [next(numbers) if w else None for w in wanted]
        at += 4 + size
    raise Damaged


def check_zip(content: bytes) -> None:
    """One volume, nothing in front or behind, each entry's directory record and local header in place."""
    end = next((m for m in _backwards(content, ZIP_END) if m + 22 <= len(content) and m + 22 + int.from_bytes(content[m + 20 : m + 22], "little") == len(content)), None)
    need(end is not None)
    disk, first_disk, here, entries, size, offset = struct.unpack_from("<4H2I", content, end + 4)
    need(disk == first_disk == 0 and here == entries)
    if entries == 0xFFFF or 0xFFFFFFFF in (size, offset):
        need(end >= 20)
        mark, volume, end, volumes = struct.unpack_from("<4sIQI", content, end - 20)
        need(mark == ZIP64_LOCATOR and volume == 0 and volumes == 1 and end + 56 <= len(content))
        mark, disk, first_disk, here, entries, size, offset = struct.unpack_from("<4s12x2I4Q", content, end)
        need(mark == ZIP64_END and disk == first_disk == 0 and here == entries)
    need(entries <= MOST_ENTRIES and offset + size == end)
    at = offset
    for _ in range(entries):
        mark, packed, whole, name, extra, comment, volume, local = struct.unpack_from("<4s16xIIHHHH6xI", content, at)
        need(mark == ZIP_ENTRY and volume == 0)
        after = at + 46 + name + extra + comment
        need(after <= end)
        wanted = [whole == 0xFFFFFFFF, packed == 0xFFFFFFFF, local == 0xFFFFFFFF]
        if any(wanted):
            numbers = _wide(content[at + 46 + name : at + 46 + name + extra], wanted)
            packed, local = (a if a is not None else b for a, b in zip(numbers[1:], (packed, local)))
        mark, name, extra = struct.unpack_from("<4s22xHH", content, local)
        need(mark == ZIP_LOCAL and local + 30 + name + extra + packed <= offset)
        at = after
    need(at == end)


def _backwards(content: bytes, mark: bytes):  # noqa: ANN202
    at = content.rfind(mark)
    while at >= 0:
        yield at
        at = content.rfind(mark, 0, at + len(mark) - 1)


def check_7z(content: bytes) -> bool:
    mark, start_crc, start = struct.unpack_from("<6s2xI20s", content)
    offset, size, tail_crc = struct.unpack("<QQI", start)
    need(mark == SEVEN_ZIP and zlib.crc32(start) == start_crc and 32 + offset + size <= len(content))
    return zlib.crc32(content[32 + offset : 32 + offset + size]) == tail_crc


def _once(pairs: list[tuple[str, object]]) -> dict:
    need(len(dict(pairs)) == len(pairs))
    return dict(pairs)


def safetensors_header(content: bytes) -> dict[str, dict]:
    """The tensors by name; each must have the bytes of its shape, and together they must fill the payload."""
    (size,) = struct.unpack_from("<Q", content)
    need(2 <= size <= min(MOST_HEADER, len(content) - 8) and content[8:9] == b"{")
    try:
        header = json.loads(content[8 : 8 + size].decode("utf-8"), object_pairs_hook=_once)
    except json.JSONDecodeError:
        raise Damaged from None
    notes = header.pop("__metadata__", {})
    need(isinstance(notes, dict) and all(isinstance(v, str) for v in notes.values()))
    spans = []
    for tensor in header.values():
        need(isinstance(tensor, dict) and set(tensor) == {"dtype", "shape", "data_offsets"} and tensor["dtype"] in DTYPE_BITS)
        shape, span = tensor["shape"], tensor["data_offsets"]
        need(isinstance(shape, list) and isinstance(span, list) and len(span) == 2 and all(type(n) is int and 0 <= n < 2**64 for n in [*shape, *span]))
        bits = DTYPE_BITS[tensor["dtype"]]
        for n in shape:
            bits *= n
            need(bits < 2**64)
        need(bits == 8 * (span[1] - span[0]))
        spans.append(span)
    spans.sort()
    need([b for b, _ in spans] + [len(content) - 8 - size] == [0] + [e for _, e in spans])
    return header


def gif_segments(content: bytes) -> list[tuple[bytes, int, int]]:
    """(kind, start, end): the head, then images, extensions by label (applications by name) and the trailer."""
    table = lambda packed: 3 << ((packed & 7) + 1) if packed & 128 else 0
    need(content[:3] == b"GIF" and len(content) >= 13)
    at = 13 + table(content[10])
    need(at <= len(content))
    segments = [(b"head", 0, at)]

    def blocks(p: int) -> int:
        while content[p]:
            p += content[p] + 1
        return p + 1

    while content[at] != 0x3B:
        if content[at] == 0x2C:
            kind, end = b"image", blocks(at + 11 + table(content[at + 9]))
        else:
            need(content[at] == 0x21)
            end = blocks(at + 2)
            kind = content[at + 3 : at + 14] if content[at + 1] == 0xFF and content[at + 2] == 11 else content[at + 1 : at + 2]
        need(end <= len(content))
        segments.append((kind, at, end))
        at = end
    return [*segments, (b"end", at, at + 1)]


def clean_gif(content: bytes) -> bytes:
    """Without comments and applications but for the two that say how often to loop."""
    return b"".join(content[a:b] for kind, a, b in gif_segments(content) if kind in (b"head", b"image", b"end", b"\xf9", b"\x01", *GIF_APPS))


def orientation(tiff: bytes) -> int:
    """The orientation of an EXIF block, 1 where it has none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (at,) = struct.unpack_from(f"{order}I", tiff, 4) if order else (len(tiff),)
        for i in range(struct.unpack_from(f"{order or '<'}H", tiff, at)[0]):
            tag, kind, count, value = struct.unpack_from(f"{order}HHIH", tiff, at + 2 + 12 * i)
            if (tag, kind, count) == (0x112, 3, 1):
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def jpeg_segments(content: bytes) -> list[tuple[int, int, int]]:
    """(marker, start, end) up to the end mark; a scan's coded data belong to its segment."""
    need(content[:2] == b"\xff\xd8")
    at, segments = 2, [(0xD8, 0, 2)]
    while segments[-1][0] != 0xD9:
        found = re.compile(rb"\xff+([^\xff])", re.S).match(content, at)
        need(found is not None)
        marker, end = found[1][0], found.end()
        if marker not in (0x01, 0xD9, *range(0xD0, 0xD8)):
            (size,) = struct.unpack_from(">H", content, end)
            end += size
            need(size >= 2 and end <= len(content))
            if marker == 0xDA:
                after = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S).search(content, end)
                need(after is not None)
                end = after.start()
        segments.append((marker, at, end))
        at = end
    return segments


def clean_jpeg(content: bytes) -> bytes:
    """Without application segments and comments but for JFIF, Adobe and colour profiles; of EXIF the orientation stays."""
    out = []
    for marker, a, b in jpeg_segments(content):
        body = content[content.index(bytes([marker]), a + 1) + 3 : b]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            if (turned := orientation(body[6:])) > 1:
                tiff = struct.pack("<2sHIHHHIHHI", b"II", 42, 8, 1, 0x112, 3, 1, turned, 0, 0)
                out.append(b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff)
        elif not (0xE0 <= marker <= 0xEF or marker == 0xFE) or marker in JPEG_KEPT_APPS and body.startswith(JPEG_KEPT_APPS[marker]):
            out.append(content[a:b])
    return b"".join(out)


def _predicate(check: Callable[[bytes], object]):  # noqa: ANN202
    return by_row(judged(check), T.BooleanType())


def _rewrite(clean: Callable[[bytes], bytes]):  # noqa: ANN202
    return by_row(cleaned(clean), T.BinaryType())


def valid_mp4(content):  # noqa: ANN001, ANN201
    return _predicate(check_mp4)(content)


def valid_zip(content):  # noqa: ANN001, ANN201
    return _predicate(check_zip)(content)


def valid_7z(content):  # noqa: ANN001, ANN201
    return _predicate(check_7z)(content)


def valid_safetensors(content):  # noqa: ANN001, ANN201
    return _predicate(safetensors_header)(content)


def gif_without_notes(content):  # noqa: ANN001, ANN201
    return _rewrite(clean_gif)(content)


def jpeg_without_notes(content):  # noqa: ANN001, ANN201
    return _rewrite(clean_jpeg)(content)


# --- files made from texts, for the queries over the driver tables ------------------------------------------------


def zip_of(text: str) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("text.txt", text)
    return held.getvalue()


def seven_zip_of(text: str) -> bytes:
    """A start header over the text as the tail; enough for what the check reads."""
    tail = text.encode()
    start = struct.pack("<QQI", 0, len(tail), zlib.crc32(tail))
    return SEVEN_ZIP + b"\0\4" + struct.pack("<I", zlib.crc32(start)) + start + tail


def safetensors_of(text: str) -> bytes:
    data = text.encode()
    header = json.dumps({"text": {"dtype": "U8", "shape": [len(data)], "data_offsets": [0, len(data)]}}).encode()
    return struct.pack("<Q", len(header)) + header + data


def _made(make: Callable[[str], bytes]):  # noqa: ANN202
    return by_row(lambda text: make(text or ""), T.BinaryType())


def to_zip(text):  # noqa: ANN001, ANN201
    return _made(zip_of)(text)


def first_text(content: bytes | None) -> str | None:
    """The text of an archive's first file."""
    if content is None:
        return None
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(z.infolist()[0]).decode()


zip_text = by_row(first_text, T.StringType())


def to_7z(text):  # noqa: ANN001, ANN201
    return _made(seven_zip_of)(text)


def to_safetensors(text):  # noqa: ANN001, ANN201
    return _made(safetensors_of)(text)


def box(kind: str, data):  # noqa: ANN001, ANN201
    """An MP4 box around a binary column, with built-in functions only."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data) + 8), 8, "0")), F.lit(kind.encode()), data)

