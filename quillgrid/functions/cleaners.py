"""Cleaners of PNG, WebP, MP4 and Matroska files, and the check of RAR archives. None (or False) for damaged input.

Video cleaners keep every byte's place: what goes is renamed to a filler of the same length.
"""

from __future__ import annotations

import struct
import zlib
from itertools import islice

from .containers import SIGNATURE, chunk_list
from .validators import _predicate, _rewrite, need, orientation

# Fixed values of the formats.
PNG_KEPT = (
    "IHDR", "PLTE", "IDAT", "IEND", "tRNS", "cHRM", "gAMA", "sRGB", "iCCP", "sBIT", "cICP", "mDCV", "cLLI", "bKGD", "pHYs", "acTL", "fcTL", "fdAT",
)
WEBP_KEPT = (b"VP8X", b"VP8 ", b"VP8L", b"ALPH", b"ANIM", b"ANMF", b"ICCP")
MP4_NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf")
MP4_DATED = (b"mvhd", b"tkhd", b"mdhd")
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
EBML_HEAD, EBML_SEGMENT, EBML_INFO, EBML_FILLER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0xEC
EBML_TAGS, EBML_ATTACHMENTS = 0x1254C367, 0x1941A469
EBML_INFO_NOTES = (0x7BA9, 0x4D80, 0x5741, 0x4461)  # title, muxer, writer, date
RAR_MARK = b"Rar!\x1a\7"
MOST_DEPTH, MOST_BLOCKS, MOST_HEADER = 16, 1_000_000, 2 * 1024 * 1024


def turned_exif(turned: int) -> bytes:
    """An EXIF block that holds the orientation alone."""
    return struct.pack("<2sHIHHHIHHI", b"II", 42, 8, 1, 0x112, 3, 1, turned, 0, 0)


# --- pictures -----------------------------------------------------------------------------------------------------


def png_of(chunks: list[tuple[str, bytes]]) -> bytes:
    parts = [(kind.encode("latin-1"), data) for kind, data in chunks]
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def clean_png(content: bytes) -> bytes:
    """The chunks that show the picture; of EXIF the orientation stays. A wrong checksum is damage."""
    chunks = chunk_list(content)
    need(chunks is not None and all(c["crc_ok"] for c in chunks))
    out = []
    for c in chunks:
        if c["type"] == "eXIf" and (turned := orientation(c["data"])) > 1:
            out.append(("eXIf", turned_exif(turned)))
        elif c["type"] in PNG_KEPT:
            out.append((c["type"], c["data"]))
    return png_of(out)


def riff_parts(content: bytes) -> list[tuple[bytes, bytes]]:
    """(type, data) of a WebP's parts."""
    mark, size, form = struct.unpack_from("<4sI4s", content)
    end, at, parts = 8 + size, 12, []
    need(mark == b"RIFF" and form == b"WEBP" and 12 <= end <= len(content))
    while at < end:
        need(at + 8 <= end)
        kind, size = struct.unpack_from("<4sI", content, at)
        need(at + 8 + size + size % 2 <= end)
        parts.append((kind, content[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return parts


def bare_exif(data: bytes) -> bytes:
    return data.removeprefix(b"Exif\0\0")


def clean_webp(content: bytes) -> bytes:
    """Without notes; flags in the head say what is left, and the sizes are made right."""
    parts = riff_parts(content)
    turned = max([orientation(bare_exif(d)) for k, d in parts if k == b"EXIF"], default=1)
    kept = []
    for kind, data in parts:
        if kind == b"VP8X":
            need(len(data) == 10)
            data = bytes([data[0] & ~0x0C | (8 if turned > 1 else 0)]) + data[1:]  # neither EXIF nor XMP, unless turned
        if kind in WEBP_KEPT:
            kept.append((kind, data))
        elif kind == b"EXIF" and orientation(bare_exif(data)) > 1:
            kept.append((kind, turned_exif(orientation(bare_exif(data)))))
    body = b"".join(struct.pack("<4sI", k, len(d)) + d + bytes(len(d) % 2) for k, d in kept)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WEBP") + body


# --- videos -------------------------------------------------------------------------------------------------------


def nested_boxes(content: bytes, at: int, end: int, depth: int = 0):  # noqa: ANN201
    """(type, start, start of the payload, end) of each MP4 box, those inside known containers too."""
    need(depth <= MOST_DEPTH)
    while at < end:
        need(end - at >= 8)
        size, kind = struct.unpack_from(">I4s", content, at)
        head = 8
        if size == 1:
            need(end - at >= 16)
            (size,), head = struct.unpack_from(">Q", content, at + 8), 16
        size = size or end - at
        need(head <= size <= end - at)
        yield kind, at, at + head, at + size
        if kind in MP4_NESTED:
            yield from nested_boxes(content, at + head, at + size, depth + 1)
        at += size


def clean_mp4(content: bytes) -> bytes:
    """Notes become free space and dates zero; encrypted files are refused."""
    out, seen = bytearray(content), set()
    need(content[4:8] == b"ftyp" and len(content) >= 16)
    for kind, start, data, end in nested_boxes(content, 0, len(content)):
        seen.add(kind)
        need(kind != b"pssh")
        if kind in (b"udta", b"meta") or kind == b"uuid" and content[data : data + 16] == XMP_UUID and end - data >= 16:
            out[start + 4 : start + 8] = b"free"
            out[data:end] = bytes(end - data)
        elif kind in MP4_DATED:
            need(data < end and content[data] in (0, 1))
            dates = 16 if content[data] else 8
            need(end - data >= 4 + dates)
            out[data + 4 : data + 4 + dates] = bytes(dates)
        elif kind == b"stsd":
            need(end - data >= 8)
            count = int.from_bytes(content[data + 4 : data + 8], "big")
            forms = [form for form, *_ in islice(nested_boxes(content, data + 8, end), count)]
            need(len(forms) == count and not {b"encv", b"enca"} & set(forms))
    need({b"moov", b"mdat"} <= seen)
    return bytes(out)


def _vint(content: bytes, at: int, most: int) -> tuple[int, int]:
    """The length in bytes of a variable number and its bits, marker included."""
    width = 9 - content[at].bit_length()
    need(width <= most and at + width <= len(content))
    return width, int.from_bytes(content[at : at + width], "big")


def elements(content: bytes, at: int, end: int):  # noqa: ANN201
    """(id, start, start of the payload, end) of the EBML elements of one level; only a segment may leave its size open."""
    while at < end:
        wide, kind = _vint(content, at, 4)
        width, size = _vint(content, at + wide, 8)
        data, size = at + wide + width, size - (1 << 7 * width)
        if size == (1 << 7 * width) - 1:
            need(kind == EBML_SEGMENT)
            size = end - data
        need(0 <= size <= end - data)
        yield kind, at, data, data + size
        at = data + size


#: What happens to an element by the ids on the way to it: looked into, or replaced by filler. All others stay.
LOOK_INTO, FILL = "look into", "fill"
EBML_RULES = {(EBML_SEGMENT,): LOOK_INTO, (EBML_SEGMENT, EBML_TAGS): FILL, (EBML_SEGMENT, EBML_ATTACHMENTS): FILL, (EBML_SEGMENT, EBML_INFO): LOOK_INTO}
EBML_RULES |= {(EBML_SEGMENT, EBML_INFO, note): FILL for note in EBML_INFO_NOTES}


def filler(length: int) -> bytes:
    """A filler element of that many bytes in all."""
    width = 1 + sum(length > (1 << 7 * w) + w - 1 for w in range(1, 8))
    need(length > width)
    return bytes([EBML_FILLER]) + (1 << 7 * width | length - 1 - width).to_bytes(width, "big") + bytes(length - 1 - width)


def clean_ebml(content: bytes) -> bytes:
    """Tags, attachments, and the title, programs and date of the segment's description become filler elements."""
    need(len(content) >= 8 and int.from_bytes(content[:4], "big") == EBML_HEAD)
    levels, filled, ways = [((), 0, len(content))], [], set()
    while levels:
        way, at, end = levels.pop()
        for kind, start, data, stop in elements(content, at, end):
            rule = EBML_RULES.get(here := (*way, kind))
            if rule == LOOK_INTO:
                levels.append((here, data, stop))
                ways.add(here)
            elif rule == FILL:
                filled.append((start, stop))
    need((EBML_SEGMENT,) in ways)
    kept, at = [], 0
    for start, stop in sorted(filled):
        kept += [content[at:start], filler(stop - start)]
        at = stop
    return b"".join([*kept, content[at:]])


# --- archives -----------------------------------------------------------------------------------------------------


def _leb(content: bytes, at: int) -> tuple[int, int]:
    """A little-endian number in groups of seven bits, and the place after it."""
    value = 0
    for i in range(10):
        byte = content[at + i]
        value |= (byte & 127) << 7 * i
        if byte < 128:
            need(value < 1 << 64)
            return value, at + i + 1
    need(False)


def _old_blocks(content: bytes):  # noqa: ANN202
    """(role, refused, end) of the blocks of format 4; role is main, end, sealed (what follows is encrypted) or other."""
    at = 7
    while at < len(content):
        crc, kind, flags, size = struct.unpack_from("<HBHH", content, at)
        need(size >= 7 and at + size <= len(content) and zlib.crc32(content[at + 2 : at + size]) & 0xFFFF == crc)
        more = 0
        if flags & 0x8000:
            need(size >= 11)
            (more,) = struct.unpack_from("<I", content, at + 7)
        if kind == 0x74 and flags & 0x100:
            need(size >= 40)
            more = struct.unpack_from("<I", content, at + 7)[0] | struct.unpack_from("<I", content, at + 32)[0] << 32
        split = flags & 3 if kind == 0x74 else flags & 1 if kind in (0x73, 0x7B) else 0
        role = "sealed" if kind == 0x73 and flags & 0x80 else {0x73: "main", 0x7B: "end"}.get(kind, "other")
        at += size + more
        yield role, bool(split), at


def _new_blocks(content: bytes):  # noqa: ANN202
    """The same for format 5."""
    at = 8
    while at < len(content):
        (crc,) = struct.unpack_from("<I", content, at)
        size, body = _leb(content, at + 4)
        need(body - at - 4 <= 3 and 2 <= size <= MOST_HEADER and body + size <= len(content))
        need(zlib.crc32(content[at + 4 : body + size]) == crc)
        header, more = content[body : body + size], 0
        kind, p = _leb(header, 0)
        flags, p = _leb(header, p)
        if flags & 1:
            _, p = _leb(header, p)
        if flags & 2:
            more, p = _leb(header, p)
        split = flags & 24 or kind in (1, 5) and _leb(header, p)[0] & 1
        at = body + size + more
        yield {1: "main", 4: "sealed", 5: "end"}.get(kind, "other"), bool(split), at


def check_rar(content: bytes) -> bool:
    """One volume of format 4 or 5 with a main header, all header checksums right; format 5 needs its end block."""
    need(content[:6] == RAR_MARK and content[6] in (0, 1) and (content[6] == 0 or content[7] == 0))
    seen = set()
    for n, (role, refused, end) in enumerate(_new_blocks(content) if content[6] else _old_blocks(content)):
        need(n < MOST_BLOCKS and not refused)
        if role == "sealed":
            return True
        need(end <= len(content))
        seen.add(role)
        if role == "end":
            break
    return "main" in seen and ("end" in seen or content[6] == 0)


def png_without_notes(content):  # noqa: ANN001, ANN201
    return _rewrite(clean_png)(content)


def webp_without_notes(content):  # noqa: ANN001, ANN201
    return _rewrite(clean_webp)(content)


def mp4_without_notes(content):  # noqa: ANN001, ANN201
    return _rewrite(clean_mp4)(content)


def ebml_without_notes(content):  # noqa: ANN001, ANN201
    return _rewrite(clean_ebml)(content)


def valid_rar(content):  # noqa: ANN001, ANN201
    return _predicate(check_rar)(content)
