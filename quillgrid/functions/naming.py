"""Short texts for people: file names, captions, sizes, ordinal marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that Windows keeps for devices, characters it refuses, and the ranges of circled numbers.
DEVICES = "CON|PRN|AUX|NUL|CLOCK\\$|COM[1-9]|LPT[1-9]"
REFUSED = r'[\x00-\x1F\x7F-\x9F<>:"/\\|?*]'
CIRCLED = ((1, 20, 0x2460), (21, 35, 0x3251), (36, 50, 0x32B1))
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")
MOST_NAME_BYTES, CAPTION_CHARACTERS = 1024, 18


def safe_name(name: Column) -> Column:
    """Whether a text can be a file's name on any system."""
    device = name.rlike(rf"(?i)^({DEVICES})(\.|\z)")
    return name.rlike(r"\S") & ~name.rlike(REFUSED) & ~name.rlike(r"[. ]\z") & ~device & (F.octet_length(name) <= MOST_NAME_BYTES)


def caption(index: Column, text: Column, empty: str = "(empty)") -> Column:
    """A layer's number (from 1) and the first 18 characters of its text, blanks merged."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.when(F.char_length(t) > CAPTION_CHARACTERS, F.concat(F.left(t, F.lit(CAPTION_CHARACTERS)), F.lit("…"))).otherwise(t)
    return F.concat((index + 1).cast("string"), F.lit(" · "), F.when(t == "", empty).otherwise(cut))


def circled(number: Column) -> Column:
    """1 to 50 as one circled character, else digits."""
    out = number.cast("string")
    for low, high, start in CIRCLED:
        marks = F.lit("".join(map(chr, range(start, start + high - low + 1))))
        out = F.when(number.between(low, high), F.substring(marks, number.cast("int") - low + 1, F.lit(1))).otherwise(out)
    return out


def size_text(n: Column) -> Column:
    """Bytes in the largest unit that keeps the number at 1 or more; tenths beyond plain bytes."""
    out = F.concat(F.floor(n + 0.5).cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[1:], 1):
        tenths = F.floor(n / F.lit(1024.0**i) * 10 + 0.5)
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1024.0**i, shown).otherwise(out)
    return out


def output_size(width: Column, height: Column, most: int) -> list[Column]:
    """Width and height shrunk to a longest side, rounded half to even, at least 1."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return [F.greatest(F.lit(1), F.rint(side * ratio).cast("int")) for side in (width, height)]


def fitted(width: Column, height: Column, frame_width: int, frame_height: int) -> list[Column]:
    """Width, height, left and top of a picture that fills a frame as far as its sides allow."""
    r = F.least(F.lit(float(frame_width)) / width, F.lit(float(frame_height)) / height)
    w, h = (F.greatest(F.lit(1).cast("long"), F.rint(side * r).cast("long")) for side in (width, height))
    return [w, h, F.floor((frame_width - w) / 2), F.floor((frame_height - h) / 2)]


def stem(text: Column) -> Column:
    """A file name's stem: characters that file systems refuse as underscores, no dots at its end, 70 characters at most."""
    clean = F.rtrim(F.left(F.rtrim(F.trim(F.regexp_replace(text, r"[\x00-\x1F<>:\x22/\\|?*]", "_")), F.lit(".")), F.lit(70)))
    return F.when(clean == "", "picture").otherwise(clean)
