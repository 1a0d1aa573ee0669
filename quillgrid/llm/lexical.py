"""Ranked lexical search by block-max pruning.

Documents are read once, into blocks of a forward index: for a range of documents (as they lie in their partition), each
one's id, number of terms and frequencies of the terms that any query asks for, and for each term of the block in how many of
its documents it is. Counts of the whole corpus follow from the blocks. With them

1. each block has the largest score of each term among its documents; summed over a query's terms that bounds what any of
   its documents can score;
2. the SEEDS best-bounded blocks of each query, of all blocks, are scored: its `top`-th best score there is a threshold that
   the whole corpus' is not below;
3. every task sorts the blocks it reads by a query's bound, and scores them from the highest on until the bound is below the
   threshold (the seeds' or, if higher, what the task itself has found). Equal bounds are scored, as ids settle ties.

Scores are integers, so results are exact. Queries are worked on in groups of about MOST_TERMS terms (one, unless there are
many); what is broadcast is a group's vocabulary, and nothing of the documents but its counts reaches the driver.

Cases: a null text, or one without a term, has no terms: such a document counts in no statistic and is never found; such an
item has no rows; null item_ids and repeated items are queries of their own; null doc_ids take part, last among equal scores;
repeated documents are separate ones; texts of any length are read whole (a block may exceed BLOCK_ENTRIES by one document);
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, removed, shared_folder

#: A block's documents, and its (document, term) pairs, at most.
BLOCK_DOCS, BLOCK_ENTRIES = 2048, 400_000
#: Terms of the queries of a group.
MOST_TERMS = 250_000
SEEDS = 4
#: Pairs of the blocks that a task holds at a time, and in how many parts a query's best documents are merged first.
HELD_ENTRIES, PARTS = 4_000_000, 256
#: Weights of the formula: length's share in percent, the other's, and twelve tenths' worth of saturation.
SHARE, SATURATION, UNIT = 25, 12, 1_000_000_000
NO_ID = np.iinfo(np.int64).max

_TERM = rb"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(i if i > 127 else bytes([i]).lower()[0] if i in _TERM else 32 for i in range(256))
_INDEX = "block long, docs long, total long, ids binary, lengths binary, first binary, term binary, tf binary, terms array<int>, holds array<int>"


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: letters and digits of ASCII in lower case, and all beyond ASCII as it is."""
    return raw.translate(_TABLE).split()


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)


@dataclass
class Block:
    """A range of documents as it is read: `close` gives its row of the index."""

    docs: int = 0
    total: int = 0
    entries: int = 0
    ids: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    found: list[np.ndarray] = field(default_factory=list)

    def add(self, doc_id: int | None, raw: bytes | None, number: dict[bytes, int]) -> None:
        words = terms(raw or b"")
        if not words:
            return
        self.docs += 1
        self.total += len(words)
        codes = np.fromiter(map(number.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        codes = codes[codes >= 0]
        if len(codes):
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.lengths.append(len(words))
            self.found.append(codes)
            self.entries += len(codes)

    def close(self, number: int) -> tuple:
        sizes = np.array([len(c) for c in self.found], dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        codes = np.concatenate(self.found) if self.found else np.zeros(0, dtype=np.int64)
        pairs, tf = np.unique(doc << 32 | codes, return_counts=True)
        term = pairs & 0xFFFFFFFF
        distinct, holds = np.unique(term, return_counts=True)
        first = np.searchsorted(pairs >> 32, np.arange(len(sizes)))
        raw = [np.array(self.ids, "<i8"), np.array(self.lengths, "<i8"), first.astype("<i4"), term.astype("<i4"), tf.astype("<i4")]
        return (number, self.docs, self.total, *[a.tobytes() for a in raw], distinct.tolist(), holds.tolist())


_INDEX_TYPES = [pa.int64()] * 3 + [pa.binary()] * 5 + [pa.list_(pa.int32())] * 2
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def index(docs: DataFrame, vocabulary: list[bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """The blocks of a forward index of `vocabulary` (at most MOST_TERMS or one query's terms). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, block = shared.value, TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, raw.as_py(), number)
                if len(block.ids) >= BLOCK_DOCS or block.entries >= BLOCK_ENTRIES:
                    yield _batch([block.close(at)], _INDEX_NAMES, _INDEX_TYPES)
                    at, block = at + 1, Block()
        if block.docs:
            yield _batch([block.close(at)], _INDEX_NAMES, _INDEX_TYPES)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(read, _INDEX)


@dataclass
class Queries:
    """A group of queries over their vocabulary, with the corpus' counts: what every task needs."""

    start: np.ndarray  # of a query's terms in `term`
    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray  # of each term of the vocabulary
    docs: int
    total: int
    top: int

    def __len__(self) -> int:
        return len(self.start) - 1

    def parts(self, lengths: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each (document, term) pair of a block adds to a score."""
        m = 100 - SHARE + SHARE * lengths * self.docs // self.total
        m = np.repeat(m, np.diff(first, append=len(term)))
        return self.weight[term] * (UNIT * tf // (1000 * tf + SATURATION * m))

    def bounds(self, term: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """For each query the sum of its terms' largest parts in a block."""
        most = np.zeros(len(self.weight), dtype=np.int64)
        np.maximum.at(most, term, parts)
        return np.add.reduceat(self.times * most[self.term], self.start[:-1])


@dataclass
class Read:
    """A block of the index as arrays, with its parts."""

    ids: np.ndarray
    first: np.ndarray
    term: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, row: dict, queries: Queries) -> Read:
        ids, lengths = (np.frombuffer(row[c], "<i8") for c in ("ids", "lengths"))
        first, term, tf = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("first", "term", "tf"))
        return cls(ids, first, term, queries.parts(lengths, first, term, tf))

    def scores(self, queries: Queries, q: int, times: np.ndarray) -> np.ndarray:
        """The scores of the block's documents; times: zeros for each term of the vocabulary, and zeros again after."""
        own = slice(queries.start[q], queries.start[q + 1])
        times[queries.term[own]] = queries.times[own]
        out = np.add.reduceat(self.parts * times[self.term], self.first)
        times[queries.term[own]] = 0
        return out


class Best:
    """The best documents of a query so far: highest scores, then least ids."""

    def __init__(self, top: int, threshold: int) -> None:
        self.top, self.threshold = top, threshold
        self.ids, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.threshold)
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.top:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


_READ = ["block", "ids", "lengths", "first", "term", "tf"]


def seeds(blocks: DataFrame, shared) -> list[tuple[int, int]]:  # noqa: ANN001
    """(query, block): the SEEDS blocks of each query with the highest bounds."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        bound, block = np.zeros((0, len(queries)), dtype=np.int64), np.zeros(0, dtype=np.int64)
        for row in _rows_of(batches):
            read = Read.of(row, queries)
            bound, block = np.concatenate([bound, queries.bounds(read.term, read.parts)[None]]), np.append(block, row["block"])
            if len(block) > 16 * SEEDS:
                keep = np.unique(np.argsort(-bound, axis=0, kind="stable")[:SEEDS])
                bound, block = bound[keep], block[keep]
        at = np.argsort(-bound, axis=0, kind="stable")[:SEEDS]
        q = np.broadcast_to(np.arange(len(queries)), at.shape)
        good = bound[at, q] > 0
        yield pa.RecordBatch.from_arrays([pa.array(q[good].astype(np.int32)), pa.array(block[at][good]), pa.array(bound[at, q][good])], names=["query", "block", "bound"])

    told = blocks.select(*_READ).mapInArrow(best, "query int, block long, bound long")
    ranked = told.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("n") <= SEEDS)
    return [(r["query"], r["block"]) for r in ranked.select("query", "block").collect()]


def thresholds(blocks: DataFrame, shared, chosen: list[tuple[int, int]]) -> np.ndarray:  # noqa: ANN001
    """The `top`-th best score of each query among its seeds; 0 where they have fewer."""
    spark, queries = blocks.sparkSession, shared.value
    asked: dict[int, list[int]] = {}
    for q, block in chosen:
        asked.setdefault(block, []).append(q)
    wanted = F.broadcast(spark.createDataFrame(list(asked.items()), "block long, queries array<int>"))  # at most SEEDS blocks a query

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, rows = shared.value, []
        times = np.zeros(len(queries.weight), dtype=np.int64)
        for row in _rows_of(batches):
            read = Read.of(row, queries)
            for q in row["queries"]:
                best = Best(queries.top, 1)
                best.add(read.ids, read.scores(queries, q, times))
                rows.append((q, best.scores.tolist()))
        yield _batch(rows, ["query", "scores"], [pa.int32(), pa.list_(pa.int64())])

    out = np.zeros(len(queries), dtype=np.int64)
    if asked:
        told = blocks.select(*_READ).join(wanted, "block").mapInArrow(score, "query int, scores array<long>")
        every = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)  # of at most SEEDS blocks
        for r in told.groupBy("query").agg(F.get(every, F.lit(queries.top - 1)).alias("least")).where("least IS NOT NULL").collect():
            out[r["query"]] = r["least"]
    return out


def best_documents(blocks: DataFrame, shared, least: np.ndarray) -> DataFrame:  # noqa: ANN001
    """(query, id, score): the best documents of each query in each task, where their scores reach the query's threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [Best(queries.top, int(t)) for t in least]
        times = np.zeros(len(queries.weight), dtype=np.int64)

        def work(held: list[Read]) -> None:
            bounds = np.array([queries.bounds(b.term, b.parts) for b in held])
            for q in range(len(queries)):
                for k in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[k, q] < max(1, best[q].threshold):
                        break
                    best[q].add(held[k].ids, held[k].scores(queries, q, times))

        held, size = [], 0
        for row in _rows_of(batches):
            held.append(Read.of(row, queries))
            size += len(held[-1].term)
            if size >= HELD_ENTRIES:
                work(held)
                held, size = [], 0
        if held:
            work(held)
        q = np.repeat(np.arange(len(queries), dtype=np.int32), [len(b.ids) for b in best])
        ids, scores = (np.concatenate([getattr(b, n) for b in best]) for n in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], names=["query", "id", "score"])

    return blocks.select(*_READ).mapInArrow(score, "query int, id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The `top` best of each query with their rank: in parts first, so that no task sorts what all tasks found of a query."""
    order = [F.desc("score"), "id"]
    part = F.pmod(F.xxhash64("id", "task"), F.lit(PARTS))
    some = found.withColumn("task", F.spark_partition_id()).withColumn("part", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top).select("query", "rank", "id", "score")


def _group(docs: DataFrame, items: list[tuple], top: int, text: str, key: str) -> DataFrame:
    """The results of some queries: (item, terms)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, words in items for t in words})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = [np.unique([number[t] for t in words], return_counts=True) for _, words in items]
    index(docs, vocabulary, text, key).write.parquet(path := f"{shared_folder(spark)}/index-{uuid.uuid4()}")
    blocks = spark.read.parquet(path)
    docs_n, total = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), dtype=np.int64)
    for r in blocks.select(F.explode(F.arrays_zip("terms", "holds")).alias("t")).groupBy("t.terms").agg(F.sum("t.holds").alias("n")).collect():
        held[r["terms"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * int(n) + 1))) for n in held], dtype=np.int64)
    start = np.cumsum([0, *[len(t) for t, _ in counted]])
    shared = spark.sparkContext.broadcast(Queries(start, np.concatenate([t for t, _ in counted]), np.concatenate([n for _, n in counted]), weight, docs_n, max(1, total), top))
    blocks = blocks.where("length(ids) > 0")
    least = thresholds(blocks, shared, seeds(blocks, shared))
    names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "query int, item_id long"))  # one row a query of the group
    found = _ranked(best_documents(blocks, shared, least), top).join(names, "query")
    out = checkpointed(found.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(int(NO_ID))).alias("doc_id"), "score"))
    removed(spark, path)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = 20, text: str = "text", key: str = "doc_id", item: str = "item_id", most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item (a row of `items` with a text)."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).cast("long").alias("item"), F.col("text").cast("binary").alias("raw")).where("length(raw) > 0")
    size = asked.agg(F.coalesce(F.sum(F.length("raw") / 2), F.lit(0.0))).first()[0]  # a term has a byte, and one follows
    groups = max(1, math.ceil(size / most_terms))
    out = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item", "raw"), F.lit(groups)) == g).collect()
        wanted = [(r["item"], words) for r in rows if (words := terms(bytes(r["raw"])))]
        if wanted:
            found = _group(docs, wanted, top, text, key)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
