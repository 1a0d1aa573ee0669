"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

A run is a stretch of words with smallest period q, at least max(LEAST, FOLD * q) words long, that can't be extended by a word
on either side and keep its period. Many documents are worked on as one array of words, in which a word's number also tells
its document, so nothing is equal across documents:

1. The windows of 1, 2, 4, ... words get names: a window of 2h words is named by the pair of names of its halves, and pairs
   are numbered by sorting them. Only windows whose halves both occur twice can occur twice, so levels shrink fast, and end
   where all names differ.
2. A run of period q holds a multiple i of q, counted from the start of its document, in its first q words; for the largest
   power of two h <= 2q, the windows of h words at i and i + q lie in the run and have one name. Grid places with that
   property are candidates; of those that follow one another in steps of q the first is enough.
3. A candidate is extended to both sides by comparing names at descending levels (the longest common extension); what is long
   enough is a run. A stretch that several periods describe has the smallest one; the others are its multiples.

Everything is exact: names are numbers, no hashes. No shuffle: a document's words are in one row.

Cases: null or empty words give no runs and an empty collapsed text; a null word is an empty one; texts of any length are
worked on whole (a group of documents may exceed GROUP_WORDS by one document); repeated rows and null keys are rows like
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A run's least number of words, and of periods.
LEAST, FOLD = 6, 4
#: Documents are worked on together up to so many words.
GROUP_WORDS = 200_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def words(text: Column) -> Column:
    """The words of a text: what stands between ASCII spaces."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def named(base: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... numbers at each place, one place more than there are. Windows that occur once have
    a negative name of their own; the last level is the last with a window that occurs twice."""
    n = len(base)
    alone = -1 - np.arange(n + 1, dtype=np.int64)
    levels, at, keys, half = [], np.arange(n), base, 1
    while len(at):
        _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[name] > 1
        if not again.any():
            break
        level = alone.copy()
        level[at[again]] = name[again]
        levels.append(level)
        half = 1 << (len(levels) - 1)
        twice = level >= 0
        at = np.flatnonzero(twice[:-half] & twice[half:])
        keys = level[at] * (n + 1) + level[at + half]
    return levels


def candidates(level: np.ndarray, low: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) for the periods low to 2 * low - 1: grid places of each document where the windows at a place and one
    period on have one name, and the grid place before isn't such a place. level: the names of windows of 2 * low words."""
    again = np.concatenate([[0], np.cumsum(level >= 0)])
    has = np.flatnonzero((again[starts + sizes] > again[starts]) & (sizes >= FOLD * low))  # others have no window twice
    periods = np.minimum(2 * low - 1, sizes[has] // FOLD) - low + 1
    doc = np.repeat(has, periods)
    period = low + np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
    steps = (sizes[doc] - (FOLD - 1) * period) // period + 1
    step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    q = np.repeat(period, steps)
    place = np.repeat(starts[doc], steps) + step * q
    hit = level[place] == level[place + q]
    first = hit.copy()
    first[1:] &= ~hit[:-1] | (step[1:] == 0)
    return place[first], q[first]


def extended(levels: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and end of the stretch around each place i in which words q apart are equal."""
    ahead, behind = np.zeros_like(i), np.zeros_like(i)
    for k in range(len(levels) - 1, -1, -1):
        x = i + ahead
        ahead += (levels[k][x] == levels[k][x + q]).astype(np.int64) << k
        x = i - behind - (1 << k)
        behind += ((x >= 0) & (levels[k][x] == levels[k][x + q])).astype(np.int64) << k
    return i - behind, i + q + ahead


def runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of documents that follow one another in `codes` (a number for each word, equal
    for equal words), by start and period; starts count from the first word of all."""
    starts = np.cumsum(sizes) - sizes
    document = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    levels = named(document * (int(codes.max(initial=0)) + 1) + codes)
    found = []
    for k in range(1, len(levels)):
        i, q = candidates(levels[k], 1 << (k - 1), starts, sizes)
        if len(i):
            start, end = extended(levels, i, q)
            long = end - start >= np.maximum(LEAST, FOLD * q)
            found.append((start[long], end[long], q[long]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, end, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    smallest = np.ones(len(q), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[smallest], end[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def _worked(lists: pa.ListArray) -> list[pa.Array]:
    """The columns of SCHEMA for some documents' words."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = pc.fill_null(lists.flatten(), "")
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = runs(codes, sizes)
    starts = np.cumsum(sizes) - sizes
    doc = np.searchsorted(starts + sizes, start, side="right")  # documents without words end where they start
    bounds = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
    told = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(start - starts[doc]), pa.array(length), pa.array(period)], fields=list(_RUN)))
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(kept))), " ")
    return [pa.array(sizes), told, collapsed]


def find_runs(docs: DataFrame, columns: list[str], words: Column) -> DataFrame:
    """`columns` of docs with the number of `words` (an array of strings), their runs by start and period, and the words that
    no run repeats, joined by a space: of each run its first period stays, unless another run repeats it."""
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), words.alias("words"))
    schema = StructType([chosen.schema["row"], *StructType.fromDDL(SCHEMA).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(lists):
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + GROUP_WORDS, side="right")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), *_worked(lists.slice(at, upto - at))], names=schema.names)
                at = upto

    return chosen.mapInArrow(work, schema).select("row.*", *StructType.fromDDL(SCHEMA).names)
