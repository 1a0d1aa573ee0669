"""QR symbols of the highest correction level, from ISO/IEC 18004: byte mode, automatic version and mask."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import by_row

# Fixed values of the standard, level H, versions 1 to 40.
CHECK_BYTES = (
    17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28,
    30, 24, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30,
)
BLOCKS = (
    1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25,
    25, 34, 30, 32, 35, 37, 40, 42, 45, 48, 51, 54, 57, 60, 63, 66, 70, 74, 77, 81,
)
FIELD, FORMAT_CODE, FORMAT_XOR, VERSION_CODE, LEVEL_H = 0x11D, 0x537, 0x5412, 0x1F25, 2
MASKS = (
    lambda y, x: (y + x) % 2, lambda y, x: y % 2, lambda y, x: x % 3, lambda y, x: (y + x) % 3, lambda y, x: (y // 2 + x // 3) % 2,
    lambda y, x: y * x % 2 + y * x % 3, lambda y, x: (y * x % 2 + y * x % 3) % 2, lambda y, x: ((y + x) % 2 + y * x % 3) % 2,
)
MOST_BYTES = 1100

EXP = [1]
for _ in range(254):
    EXP.append(EXP[-1] << 1 ^ (FIELD if EXP[-1] & 128 else 0))
LOG = {v: i for i, v in enumerate(EXP)}


def remainder(value: int, code: int, bits: int) -> int:
    """The check bits of a binary cyclic code."""
    left = value << bits
    while left.bit_length() > bits:
        left ^= code << left.bit_length() - code.bit_length()
    return left


def times(a: int, b: int) -> int:
    return EXP[(LOG[a] + LOG[b]) % 255] if a and b else 0


@lru_cache(None)
def divisor_of(n: int) -> list[int]:
    """The Reed-Solomon generator of degree n, highest power first."""
    divisor = [1]
    for i in range(n):
        divisor = [a ^ times(b, EXP[i]) for a, b in zip([*divisor, 0], [0, *divisor])]
    return divisor


@lru_cache(None)
def steps(n: int) -> list[int]:
    """What each leading byte leaves of the generator of degree n, as a number of n bytes."""
    return [int.from_bytes(bytes(times(d, lead) for d in divisor_of(n)[1:])) for lead in range(256)]


def check_bytes(data: bytes, n: int) -> bytes:
    """The Reed-Solomon remainder of degree n."""
    table, top, left = steps(n), 8 * n - 8, 0
    for b in data:
        lead = left >> top
        left = (left ^ lead << top) << 8 ^ table[lead ^ b]
    return left.to_bytes(n)


def centres(version: int) -> list[int]:
    """Where alignment marks stand along each side."""
    if version == 1:
        return []
    n, last = version // 7 + 2, version * 4 + 10
    step = 26 if version == 32 else (version * 4 + n * 2 + 1) // (n * 2 - 2) * 2
    return [6, *sorted(last - step * i for i in range(n - 1))]


@lru_cache(None)
def template(version: int) -> tuple[np.ndarray, np.ndarray]:
    """(modules, taken): the marks of a symbol, and which places are no data."""
    side = version * 4 + 17
    dark, taken = np.zeros((side, side), bool), np.zeros((side, side), bool)
    dark[6, ::2] = dark[::2, 6] = taken[6] = taken[:, 6] = True
    ring = lambda r: np.maximum(*np.abs(np.mgrid[-r : r + 1, -r : r + 1]))
    spots = centres(version)
    for y in spots:
        for x in spots:
            if (y, x) not in ((6, 6), (6, spots[-1]), (spots[-1], 6)):
                dark[y - 2 : y + 3, x - 2 : x + 3] = ring(2) != 1
                taken[y - 2 : y + 3, x - 2 : x + 3] = True
    finder = np.isin(ring(4), (0, 1, 3))
    for y, x in ((3, 3), (3, side - 4), (side - 4, 3)):
        a, b, c, d = max(0, y - 4), min(side, y + 5), max(0, x - 4), min(side, x + 5)
        dark[a:b, c:d] = finder[a - y + 4 : b - y + 4, c - x + 4 : d - x + 4]
        taken[a:b, c:d] = True
    taken[:9, :9] = taken[:9, -8:] = taken[-8:, :9] = True
    if version >= 7:
        bits = version << 12 | remainder(version, VERSION_CODE, 12)
        block = np.array([bits >> i & 1 for i in range(18)], bool).reshape(6, 3)
        dark[:6, -11:-8], dark[-11:-8, :6] = block, block.T
        taken[:6, -11:-8] = taken[-11:-8, :6] = True
    return dark, taken


@lru_cache(None)
def places(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the data places in reading order: pairs of columns from the right, up and down by turns."""
    taken = template(version)[1]
    side, out = len(taken), []
    for turn, right in enumerate([*range(side - 1, 6, -2), *range(5, 0, -2)]):
        rows = range(side) if turn % 2 else range(side - 1, -1, -1)
        out += [(y, x) for y in rows for x in (right, right - 1) if not taken[y, x]]
    return tuple(np.array(out).T)


@lru_cache(None)
def capacity(version: int) -> tuple[int, int]:
    """(all bytes, data bytes) of a symbol."""
    whole = int((~template(version)[1]).sum()) // 8
    return whole, whole - CHECK_BYTES[version - 1] * BLOCKS[version - 1]


@lru_cache(None)
def interleaved(version: int) -> tuple[list[int], np.ndarray]:
    """(ends, order): where the blocks of the data end, and which data byte stands at each place of the symbol."""
    n, room = BLOCKS[version - 1], capacity(version)[1]
    ends = [room // n * (i + 1) + max(0, i + 1 - (n - room % n)) for i in range(n)]
    blocks = [range(a, b) for a, b in zip([0, *ends], ends)]
    return ends, np.array([b[i] for i in range(len(blocks[-1])) for b in blocks if i < len(b)])


def codewords(data: bytes, version: int) -> np.ndarray:
    """The data in its frame, cut into blocks, with check bytes, interleaved."""
    room, width = capacity(version)[1], 1 if version < 10 else 2
    head = 4 << 8 * width | len(data)
    framed = (head << 8 * len(data) + 4 | int.from_bytes(data) << 4).to_bytes(len(data) + width + 1)
    framed += (b"\xec\x11" * room)[: room - len(framed)]
    ends, order = interleaved(version)
    checks = b"".join(check_bytes(framed[a:b], CHECK_BYTES[version - 1]) for a, b in zip([0, *ends], ends))
    return np.r_[np.frombuffer(framed, np.uint8)[order], np.frombuffer(checks, np.uint8).reshape(len(ends), -1).T.ravel()]


def number(modules: np.ndarray) -> int:
    """A square of modules as one number, a bit for each in reading order."""
    bits = np.packbits(modules)
    return int.from_bytes(bits.tobytes()) >> 8 * len(bits) - modules.size


@lru_cache(None)
def starts(side: int, width: int) -> int:
    """The places (bits) from which so many modules of a line stand on."""
    return number(np.tile(np.arange(side) <= side - width, (side, 1)))


def penalty(rows: int, columns: int, side: int) -> int:
    """The standard's four marks against a mask: runs, squares, finder look-alikes, unbalance. The symbol is given twice, as the
    numbers of its modules in rows and in columns; shifted to the left by one, a module's bit is that of the next one in its line."""
    total, every = 10 * int(abs(rows.bit_count() / side**2 * 100 - 50) // 5), starts(side, 1)
    for lines in (rows, columns):
        same = ~(lines ^ lines << 1) & starts(side, 2)
        three = same & same << 1
        five = three & three << 2
        total += five.bit_count() + 2 * (five & ~(five >> 1)).bit_count()
        if lines is rows:
            total += 3 * (same & same << side & ~(lines ^ lines << side)).bit_count()
        light = lines ^ every
        two = light & light << 1
        margin, finder = two & two << 2, lines & light << 1 & lines << 2 & lines << 3 & lines << 4 & light << 5 & lines << 6
        total += 40 * sum(x.bit_count() for x in (finder & margin << 7 & starts(side, 11), margin & finder << 4 & starts(side, 11)))
    return total


def with_format(dark: np.ndarray, mask: int) -> np.ndarray:
    """The 15 format bits, twice, and the module that is always dark."""
    value = LEVEL_H << 3 | mask
    bits = (value << 10 | remainder(value, FORMAT_CODE, 10)) ^ FORMAT_XOR
    bit, out = [bool(bits >> i & 1) for i in range(15)], dark.copy()
    for i in range(15):
        y, x = (i + (i > 5), 8) if i < 8 else (8, 7) if i == 8 else (8, 14 - i)
        out[y, x] = bit[i]
        if i < 8:
            out[8, -1 - i] = bit[i]
        else:
            out[i - 15, 8] = bit[i]
    out[-8, 8] = True
    return out


@lru_cache(None)
def flips(version: int, mask: int) -> np.ndarray:
    """Which of the data places a mask turns over."""
    return MASKS[mask](*places(version)) == 0


@lru_cache(None)
def masked(version: int, mask: int) -> tuple[np.ndarray, int, int]:
    """What a mask and the marks make of a symbol without data, as modules and as numbers by rows and by columns."""
    made = template(version)[0].copy()
    made[places(version)] = flips(version, mask)
    made = with_format(made, mask)
    return made, number(made), number(made.T)


@lru_cache(None)
def version_for(n: int) -> int:
    return next(v for v in range(1, 41) if 4 + (8 if v < 10 else 16) + 8 * n <= 8 * capacity(v)[1])


def encode(text: str, mask: int = -1, margin: int = 4) -> np.ndarray:
    """The modules of a text's symbol, True for dark; mask -1 takes the one with the least penalty, the first at ties."""
    data = text.encode()
    version = version_for(len(data))
    y, x = places(version)
    bits = np.unpackbits(codewords(data, version))
    side = version * 4 + 17
    made = np.zeros((side, side), bool)
    made[y[: len(bits)], x[: len(bits)]] = bits
    if mask < 0:
        rows, columns = number(made), number(made.T)
        mask = min(range(8), key=lambda m: penalty(rows ^ masked(version, m)[1], columns ^ masked(version, m)[2], side))
    out = np.zeros((side + 2 * margin, side + 2 * margin), bool)
    out[margin : margin + side, margin : margin + side] = made ^ masked(version, mask)[0]
    return out


def read(modules: np.ndarray, margin: int = 4) -> str:
    """The text of an undamaged symbol that `encode` made."""
    m = modules[margin : len(modules) - margin, margin : len(modules) - margin]
    version = (len(m) - 17) // 4
    mask = int(np.dot(m[8, 2:5], (4, 2, 1))) ^ FORMAT_XOR >> 10 & 7
    whole, room = capacity(version)
    framed = np.empty(room, np.uint8)
    framed[interleaved(version)[1]] = np.packbits((m[places(version)] ^ flips(version, mask))[: whole * 8])[:room]
    width = 1 if version < 10 else 2
    stream = int.from_bytes(framed.tobytes()) << 4 & (1 << room * 8) - 1
    shifted = stream.to_bytes(room)
    size = int.from_bytes(shifted[:width])
    return shifted[width : width + size].decode()


SYMBOL = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("modules", T.BinaryType())])


def packed_symbol(text: str | None) -> tuple[int | None, bytes | None]:
    """The side and the modules, one byte (0 or 1) each in rows; null for null, blank and too long texts."""
    if not text or not text.strip() or len(text.encode()) > MOST_BYTES:
        return None, None
    made = encode(text)
    return len(made), made.astype(np.uint8).tobytes()


def packed_text(side: int | None, modules: bytes | None) -> str | None:
    return None if modules is None else read(np.frombuffer(modules, np.uint8).reshape(side, side).astype(bool))


symbol = by_row(packed_symbol, SYMBOL)
symbol_text = by_row(packed_text, T.StringType())


def constrained(channels: list[Column], ink: Column, low: Column, high: Column) -> list[Column]:
    """Channels (0-255) made dark enough for ink (luma at most low) or light enough for ground (at least high)."""
    r, g, b = channels
    luma = F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b
    darker, lighter = low / F.greatest(F.lit(1.0), luma), (high - luma) / F.greatest(F.lit(1.0), 255 - luma)
    return [F.when(ink & (luma > low), F.rint(c * darker)).when(~ink & (luma < high), F.rint(c + (255 - c) * lighter)).otherwise(c).cast("int") for c in channels]
