"""Writing pictures: PNG with adaptive predictors, a PNG with a second picture behind its cover, GIF without compression.

Pixels are numpy arrays (rows, columns, 4) of bytes, red, green, blue, opacity.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .cleaners import png_of
from .containers import chunk_list
from .validators import need

# Fixed values of the formats; the marker's text is what readers of such files look for.
PIECE, MARKER = 65536, b"ChatBarApngDisguise\x001;STATIC;1"
GIF_LOOP = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
CLEAR_EVERY, CLEAR, STOP = 250, 256, 257


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def predicted(pixels: np.ndarray) -> bytes:
    """Rows behind the number of the predictor whose residues are least in sum; the first at ties."""
    rows = pixels.reshape(len(pixels), -1).astype(int)
    up = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    left, corner = (np.hstack([np.zeros((len(rows), 4), int), r[:, :-4]]) for r in (rows, up))
    guesses = np.stack([np.zeros_like(rows), left, up, (left + up) // 2, paeth(left, up, corner)])
    residues = ((rows - guesses) % 256).astype(np.uint8)
    best = np.abs(residues.view(np.int8).astype(int)).sum(2).argmin(0)
    return b"".join(bytes([k]) + residues[k, i].tobytes() for i, k in enumerate(best))


def packed(pixels: np.ndarray) -> bytes:
    """The smaller of the predicted and the plain rows, compressed."""
    plain = np.hstack([np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), -1)]).tobytes()
    return min((zlib.compress(raw, 9) for raw in (predicted(pixels), plain)), key=len)


def head(pixels: np.ndarray) -> tuple[str, bytes]:
    return "IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 6, 0, 0, 0)


def pieces(data: bytes) -> Iterable[bytes]:
    return (data[i : i + PIECE] for i in range(0, len(data), PIECE))


def png(pixels: np.ndarray) -> bytes:
    return png_of([head(pixels), *[("IDAT", p) for p in pieces(packed(pixels))], ("IEND", b"")])


def dual_png(cover: np.ndarray, real: np.ndarray) -> bytes:
    """The cover for readers of still pictures; players of animations show the real one, then a clear dot over it."""
    need(cover.shape == real.shape)
    frames = [(real.shape[1], real.shape[0], 0, packed(real)), (1, 1, 1, zlib.compress(bytes(5)))]
    chunks, n = [head(cover), ("acTL", struct.pack(">II", 2, 0)), ("tEXt", MARKER), *[("IDAT", p) for p in pieces(packed(cover))]], 0
    for width, height, blend, data in frames:
        chunks.append(("fcTL", struct.pack(">5IHHBB", n, width, height, 0, 0, 10, 100, 0, blend)))
        for k, piece in enumerate(pieces(data), n + 1):
            chunks.append(("fdAT", struct.pack(">I", k) + piece))
            n = k
        n += 1
    return png_of([*chunks, ("IEND", b"")])


def unpacked(data: bytes, width: int, height: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    need(len(raw) == height * (width * 4 + 1))
    lines = raw.reshape(height, -1)
    out = np.zeros((height + 1, width + 1, 4), int)
    for y in range(height):
        kind, line, up = lines[y, 0], lines[y, 1:].reshape(width, 4).astype(int), out[y]
        if kind in (0, 2):
            out[y + 1, 1:] = line + (up[1:] if kind else 0)
        elif kind == 1:
            out[y + 1, 1:] = line.cumsum(0)
        else:
            for x in range(1, width + 1):  # each depends on the one before
                left = out[y + 1, x - 1]
                out[y + 1, x] = (line[x - 1] + ((left + up[x]) // 2 if kind == 3 else paeth(left, up[x], up[x - 1]))) % 256
        out[y + 1] %= 256
    return out[1:, 1:].astype(np.uint8)


def pictures(content: bytes | None) -> list[np.ndarray] | None:
    """The still picture of an 8-bit RGBA PNG, and the first frame behind it if there is one."""
    chunks = chunk_list(content)
    if not chunks or chunks[0]["data"][8:] != bytes([8, 6, 0, 0, 0]):
        return None
    width, height = struct.unpack(">II", chunks[0]["data"][:8])
    found = [unpacked(b"".join(c["data"] for c in chunks if c["type"] == "IDAT"), width, height)]
    starts = [i for i, c in enumerate(chunks) if c["type"] == "fcTL"] + [len(chunks)]
    if len(starts) > 1:
        width, height = struct.unpack(">II", chunks[starts[0]]["data"][4:12])
        found.append(unpacked(b"".join(c["data"][4:] for c in chunks[starts[0] : starts[1]] if c["type"] == "fdAT"), width, height))
    return found


def gif(frames: list[np.ndarray], delay_ms: int, loop: bool = True) -> bytes:
    """Frames of one size in a palette of 3, 3 and 2 bits. Codes stay 9 bits wide, as the table is cleared in time."""
    height, width = frames[0].shape[:2]
    palette = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3))
    out = [b"GIF89a", struct.pack("<HH", width, height), b"\xf7\0\0", palette, GIF_LOOP if loop else b""]
    for frame in frames:
        need(frame.shape[:2] == (height, width))
        r, g, b = (frame[..., i].ravel().astype(int) for i in range(3))
        colours = r >> 5 << 5 | g >> 5 << 2 | b >> 6
        codes = np.concatenate([np.r_[CLEAR, colours[i : i + CLEAR_EVERY]] for i in range(0, len(colours), CLEAR_EVERY)] + [[STOP]])
        data = np.packbits((codes[:, None] >> np.arange(9) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        blocks = b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255)))
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<H", max(2, delay_ms // 10)) + b"\0\0\x2c" + struct.pack("<4HB", 0, 0, width, height, 0) + b"\x08" + blocks + b"\0")
    return b"".join(out) + b"\x3b"


# --- one image a group, as rows (image, y, x, v) of gray values ---------------------------------------------------


def _canvas(part: pd.DataFrame) -> np.ndarray:
    out = np.full((part["y"].max() + 1, part["x"].max() + 1, 4), 255, np.uint8)
    out[part["y"], part["x"], :3] = part["v"].to_numpy(np.uint8)[:, None]
    return out


def as_png(pixels: DataFrame) -> DataFrame:
    """(image, png): an image is held whole, as a codec must; the number of images is free."""
    return pixels.groupBy("image").applyInPandas(lambda p: pd.DataFrame({"image": p["image"].iloc[:1], "png": [png(_canvas(p))]}), "image long, png binary")


def as_dual(pixels: DataFrame) -> DataFrame:
    """(image, png) with the image's negative as the cover."""

    def made(p: pd.DataFrame) -> pd.DataFrame:
        real = _canvas(p)
        cover = np.dstack([255 - real[..., :3], real[..., 3:]])
        return pd.DataFrame({"image": p["image"].iloc[:1], "png": [dual_png(cover, real)]})

    return pixels.groupBy("image").applyInPandas(made, "image long, png binary")


def from_png(images: DataFrame, last: bool = False) -> DataFrame:
    """(image, y, x, v) of (image, png) rows, of the frame behind the cover if `last`."""

    def rows(parts):  # noqa: ANN001, ANN202
        for part in parts:
            for image, content in zip(part["image"], part["png"]):
                if found := pictures(content):
                    plane = found[-1 if last else 0][..., 0]
                    y, x = np.indices(plane.shape)
                    yield pd.DataFrame({"image": image, "y": y.ravel(), "x": x.ravel(), "v": plane.ravel()})

    return images.mapInPandas(rows, "image long, y int, x int, v int")


def as_gif(pixels: DataFrame, job: str, delay_ms: int = 100) -> DataFrame:
    """(job, gif) of (`job`, image, y, x, v): one frame an image, in the order of images. A smaller image is padded with
    white below and to the right."""

    def made(p: pd.DataFrame) -> pd.DataFrame:
        frames = [_canvas(f) for _, f in p.groupby("image", sort=True)]
        height, width = (max(f.shape[i] for f in frames) for i in (0, 1))
        frames = [np.pad(f, ((0, height - f.shape[0]), (0, width - f.shape[1]), (0, 0)), constant_values=255) for f in frames]
        return pd.DataFrame({job: p[job].iloc[:1], "gif": [gif(frames, delay_ms)]})

    return pixels.groupBy(job).applyInPandas(made, f"{job} long, gif binary")
