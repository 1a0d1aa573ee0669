"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that repeats itself compresses too well, noise compresses too little; how well clean prose compresses
depends on its length, so every band of lengths has its own limits.

Cases: null or empty text has no words and fails the base rule; texts of any length are compressed whole;
repeated rows and ties are judged alike, one row out for one row in; an empty table gives an empty result;
other columns of the input are ignored by `assess` and kept untouched by `keep_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (bytes below which a row holds, least ratio, greatest ratio) for whole texts. Below 128 bytes a ratio says nothing.
WHOLE_BANDS = (
    (128, 0.0, 99.0),
    (256, 0.85, 2.2),
    (512, 1.0, 2.4),
    (1024, 1.15, 2.5),
    (2048, 1.25, 2.6),
    (4096, 1.35, 2.7),
    (8192, 1.4, 2.85),
    (32768, 1.45, 3.1),
    (float("inf"), 1.5, 3.4),
)
#: The same for chunks. A last chunk under 1024 bytes is judged as part of the one before.
CHUNK_BANDS = ((1024, 0.0, 99.0), (2048, 1.2, 2.7), (float("inf"), 1.3, 2.8))
CHUNK_BYTES, LEAST_CHUNK = 4096, 1024
#: (chunks below which a row holds, share of chunks outside their band above which the text goes): in a text of a few chunks
#: each is much of it, in a long one chance puts some just outside.
BAD_CHUNKS = ((5, 0.5), (17, 0.25), (float("inf"), 0.15))
LEVEL = 3

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks long, n_chunks long, kept boolean"
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(6364136223846793005)


def band(bands: tuple, n_bytes: int, ratio: float) -> bool:
    """Whether the ratio lies within the limits of its length."""
    low, high = next((low, high) for top, low, high in bands if n_bytes < top)
    return low <= ratio <= high


def cut(raw: bytes) -> list[bytes]:
    """The chunks of a text that has more than one: of CHUNK_BYTES, the last one up to LEAST_CHUNK longer."""
    edges = list(range(0, len(raw), CHUNK_BYTES))
    if len(raw) - edges[-1] < LEAST_CHUNK if edges else False:
        edges.pop()
    return [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)])] if len(edges) > 1 else []


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found at least twice in the text."""
    starts = len(words) - width + 1
    if starts < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), dtype=np.uint64, count=len(words))
    ids = (ids ^ (ids << np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    roll = np.zeros(starts, dtype=np.uint64)
    for j in range(width):
        roll = (roll ^ (roll >> np.uint64(31))) * _MIX + ids[j : j + starts]
    order = np.argsort(roll, kind="stable")
    same = roll[order[1:]] == roll[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(starts, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def assess_text(text: str | None, compressor: zstandard.ZstdCompressor | None = None) -> tuple:
    """The columns of SCHEMA for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACE))
    n_symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_window_words(words)
    failed = n_words < 20 or 100 * repeats > 30 * n_words
    compressor = compressor or zstandard.ZstdCompressor(level=LEVEL)
    ratio = len(raw) / len(compressor.compress(raw)) if raw else 0.0
    chunks = cut(raw)
    bad = sum(not band(CHUNK_BANDS, len(x), len(x) / len(compressor.compress(x))) for x in chunks)
    share = next(share for top, share in BAD_CHUNKS if len(chunks) < top)
    judged = len(chunks)
    kept = not failed and band(WHOLE_BANDS, len(raw), ratio) and bad <= share * judged
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, failed, ratio, bad, judged, kept


def _assessed(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """row (a struct of `columns`) and the columns of SCHEMA."""
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"))
    schema = StructType([chosen.schema["row"], *StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        types = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            # one text at a time becomes a Python string: a batch of very long ones isn't copied whole
            rows = [assess_text(x.as_py(), compressor) for x in batch.column(1)]
            out = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], type=t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=schema.names)

    return chosen.mapInArrow(run, schema)


def assess(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of docs with the counts, ratios and verdict of each whole text; no shuffle."""
    return _assessed(docs, columns, text).select("row.*", *StructType.fromDDL(SCHEMA).names)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they were, that pass the base rule and the bands."""
    return _assessed(docs, docs.columns, "text").where("kept").select("row.*")


def measured_bands(docs: DataFrame, text: str = "text", share: float = 0.001) -> DataFrame:
    """(chunks, top, texts, low, middle, high): for each band of WHOLE_BANDS and CHUNK_BANDS the quantiles `share`, 1/2 and
    1 - share of the ratios of docs, which should be known to be clean. The bands' limits are set outside of those."""

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for x in batch.column(0):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                for chunk, part in [(False, raw), *[(True, c) for c in cut(raw)]]:
                    if part:
                        top = next(t for t, _, _ in (CHUNK_BANDS if chunk else WHOLE_BANDS) if len(part) < t)
                        rows.append((chunk, float(top), len(part) / len(compressor.compress(part))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.bool_(), pa.float64(), pa.float64()))], names=["chunks", "top", "ratio"])

    told = docs.select(F.col(text).alias("text")).mapInArrow(ratios, "chunks boolean, top double, ratio double")
    at = F.percentile_approx("ratio", [share, 0.5, 1 - share], 10_000)
    found = told.groupBy("chunks", "top").agg(F.count("*").alias("texts"), at.alias("q"))
    return found.select("chunks", "top", "texts", *[F.get("q", i).alias(n) for i, n in enumerate(("low", "middle", "high"))])
