"""LM scoring with a hashed maximum-entropy model over n-gram and skip features, with class-factored softmax.

P(word | history) = P(class | history) * P(code | class, word before) * P(word | code). Frequent words are codes of their own;
how many follows the corpus (`Size`). The others share codes by a hash of their ending, and within such a code a word has
its add-one share. The most frequent words are classes, the other codes share classes. P(class | history) is a softmax of a
bias and three feature weights: the code before (bigram), the one before that (skip) and both (hashed trigram), with a table
that also follows the corpus. P(code | class, word before) is a softmax of the code's share and a weight for both codes.

1. Each task cuts its texts into blocks of tokens, and numbers a block's words; blocks send their words to hash buckets
   once, which add up exact corpus counts and send each block the counts of its own words. No vocabulary is ever
   collected or broadcast: what moves is every block's word list, which grows with the corpus.
2. Blocks turn tokens into codes, and count (history, class) and (code, next code) pairs of training documents. The counts
   of the whole corpus are added up by history, FAN blocks at a time and then FAN of those, so that what a task reads is
   bounded by FAN shards' counts however large the corpus.
3. Weights are trained on all these counts by distributed gradient updates: shards return gradients of a bounded size, added
   up by slices before they reach the driver, which applies a step scaled by each feature's count. The weights of two codes
   depend on one code's counts alone: a shard takes all its updates of those by itself.
4. Documents are scored in sparse numpy batches: each distinct history of a batch once.

Cases: null or empty text is the end token alone; texts of any length are one document each (a block may exceed
BLOCK_TOKENS by one document); null doc_ids count as the empty string for the split; repeated rows are separate
documents; ties in frequency go to the smaller hash; with no training document every word has count 0 and the model is
uniform over classes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words that are codes of their own, at least and at most; other words share ENDINGS codes.
LEAST_FREQUENT, MOST_FREQUENT, ENDINGS = 512, 2048, 128
#: Classes: the most frequent words, then groups of codes.
OWN_CLASS, ENDING_CLASSES = 40, 24
CLASSES = OWN_CLASS + ENDING_CLASSES
SHARDS, FAN = 64, 16
#: Slices of the weights in which gradients are added up.
SLICES = 8
#: Tasks of a gradient update: what they work on is bounded, and each returns two arrays of the weights' size.
UPDATE_TASKS = 6
ROUNDS = 9
RIDGE = 4.0
PAIR_ROUNDS, PAIR_RIDGE = 20, 2.0
BLOCK_TOKENS = 1_200_000
END = b""

_LOG10 = np.log(10)
_END_HASH = np.array([xxhash.xxh64_intdigest(END)], dtype=np.uint64)[0]


@dataclass(frozen=True)
class Size:
    """The model's size. It doubles where the corpus grows fourfold, as the number of words seen often enough does; what the
    driver and a task hold of it stays within MOST_FREQUENT."""

    frequent: int = LEAST_FREQUENT

    @classmethod
    def of(cls, tokens: int) -> Size:
        wanted = 2 ** int(np.log2(max(1.0, tokens) ** 0.5 / 16 + 1e-9)) if tokens > 256 else 1
        return cls(max(LEAST_FREQUENT, min(MOST_FREQUENT, wanted)))

    @property
    def codes(self) -> int:
        """The last one: before the text."""
        return self.frequent + ENDINGS + 1

    @property
    def trigrams(self) -> int:
        return 16 * self.frequent

    @property
    def rows(self) -> int:
        """Rows of weights: a bias and three features."""
        return 1 + 2 * self.codes + self.trigrams


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(z := zstandard.compress(a.tobytes(), 1)).to_bytes(8, "little") + z for a in arrays)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(zstandard.decompress(data[at + 8 : at + 8 + n]), dtype=t))
        at += 8 + n
    return out


def _pack_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as their differences, and counts."""
    return _pack(np.diff(keys, prepend=0), n)


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = _unpack(data, "<i8", "<i8")
    return np.cumsum(steps), n


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words and the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class _Numbers(dict):
    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


_LAYOUT = "block long, kind int, bucket int, doc_id long, held_out boolean, data binary"
_NAMES = ["block", "kind", "bucket", "doc_id", "held_out", "data"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=_NAMES)


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """kind 0: a document's tokens as numbers of its block's words. kind 1: a block's words of one hash bucket: hashes,
    endings and counts in training documents; words are numbered by bucket, then hash."""
    held = F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2, F.lit(False))

    def close(block: int, words: dict, held_docs: list, train: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        endings = np.fromiter((xxhash.xxh32_intdigest(w.rstrip(b".,;:!?")[-3:]) % ENDINGS for w in words), dtype=np.uint8, count=n)
        counts = np.zeros(n, dtype=np.int64)
        for ids in train:
            counts += np.bincount(ids, minlength=n)
        bucket = (hashes % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((hashes, bucket))
        number = np.empty(n, dtype=np.int32)
        number[order] = np.arange(n, dtype=np.int32)
        out, size = [], 0
        for doc_id, h, ids in held_docs:
            out.append((block, 0, -1, doc_id, h, _pack(number[ids])))
            size += 4 * len(ids)
            if size > 8_000_000:
                yield _rows(out)
                out, size = [], 0
        yield _rows(out)
        hashes, endings, counts, bucket = hashes[order], endings[order], counts[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        parts = [(block, 1, k, None, None, _pack(np.diff(hashes[a:b], prepend=np.uint64(0)), endings[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        yield _rows(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, kept, train, size = TaskContext.get().partitionId() << 20, _Numbers(), [], [], 0
        for batch in batches:
            ids, helds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, h, text in zip(ids, helds, batch.column(2)):
                t = tokens(text.as_py())
                numbers = np.fromiter(map(words.__getitem__, t), dtype=np.int32, count=len(t))
                kept.append((doc_id, h, numbers))
                if not h:
                    train.append(numbers)
                size += len(t)
                if size >= BLOCK_TOKENS:
                    yield from close(block, words, kept, [np.concatenate(train)] if train else [])
                    block, words, kept, train, size = block + 1, _Numbers(), [], [], 0
        if kept:
            yield from close(block, words, kept, [np.concatenate(train)] if train else [])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, _LAYOUT)


def _count(words: DataFrame, buckets: int) -> DataFrame:
    """kind 1: for each block and bucket the corpus counts and endings of its words, and which are among the bucket's
    MOST_FREQUENT most frequent (with their hashes). kind 2, one for each bucket: those words, and sums by ending."""

    def close(bucket: int, blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(data, "<u8", "u1", "<i8") for _, data in blocks]
        parts = [(np.cumsum(d, dtype=np.uint64), e, c) for d, e, c in parts]
        every, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        count = np.bincount(where, np.concatenate([p[2] for p in parts])).astype(np.int64)
        ending = np.concatenate([p[1] for p in parts])[first]
        known = np.flatnonzero(count)
        top = known[np.lexsort((every[known], -count[known]))][:MOST_FREQUENT]
        is_top = np.zeros(len(every), dtype=bool)
        is_top[top] = True
        at = 0
        for (block, _), (h, e, _) in zip(blocks, parts):
            mine = where[at : at + len(h)]
            at += len(h)
            marked = np.flatnonzero(is_top[mine]).astype(np.int32)
            yield _rows([(block, 1, bucket, None, None, _pack(count[mine], e, marked, h[marked]))])
        words = np.bincount(ending[known], minlength=ENDINGS).astype(np.int64)
        total = np.bincount(ending[known], count[known], minlength=ENDINGS).astype(np.int64)
        yield _rows([(-1, 2, bucket, None, None, b"".join(a.tobytes() for a in (words, total, every[top], count[top], ending[top].astype(np.int64))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now:
                    if held:
                        yield from close(now, held)
                    now, held = bucket, []
                held.append((block, data))
        if held:
            yield from close(now, held)

    return words.select("block", "bucket", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _LAYOUT)


def _summary(counted: DataFrame) -> tuple[int, int, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Training tokens, distinct ones, the most frequent (hash, count, ending), and words and tokens by
    ending: added up by Spark; only these bounded results reach the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                a = np.frombuffer(data, dtype=np.int64)
                n = (len(a) - 2 * ENDINGS) // 3
                top = a[2 * ENDINGS :].reshape(3, n)
                kind = np.concatenate([np.zeros(ENDINGS), np.ones(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([np.arange(ENDINGS), top[2]])), pa.array(np.concatenate([a[ENDINGS : 2 * ENDINGS], top[1]])), pa.array(np.concatenate([a[:ENDINGS], top[0]]))], names=["kind", "ending", "tokens", "words"])

    parts = checkpointed(counted.where("kind = 2").select("data").mapInArrow(split, "kind int, ending long, tokens long, words long"))
    words, total = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
    for r in parts.where("kind = 0").groupBy("ending").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect():
        words[r["ending"]], total[r["ending"]] = r["w"], r["t"]
    # the end token has a class of its own in any case
    end = int(_END_HASH.astype(np.int64))
    best = parts.where("kind = 1").orderBy(F.col("words") != end, F.desc("tokens"), "words").limit(Size.of(int(total.sum())).frequent).collect()
    return int(total.sum()), int(words.sum()), [(r["words"], r["tokens"], r["ending"]) for r in best], words, total


class Plan:
    """What the counts of the whole corpus fix: size, codes, classes and the shares within codes and classes."""

    def __init__(self, n: int, v: int, best: list[tuple[int, int, int]], words: np.ndarray, total: np.ndarray) -> None:
        self.n, self.v, self.size = n, v, Size.of(n)
        frequent = self.size.frequent
        self.code = {h: i for i, (h, _, _) in enumerate(best)}
        group = OWN_CLASS + np.arange(ENDINGS) % ENDING_CLASSES
        self.class_of = np.zeros(self.size.codes, dtype=np.int64)  # by code
        self.class_of[:frequent] = np.minimum(np.arange(frequent), OWN_CLASS)
        self.class_of[frequent : frequent + ENDINGS] = group
        #: Tokens of a code, one more for each of its words, and in endings' codes for one unknown word.
        self.weight = np.full(self.size.codes, 1e-9)
        words, total = words.astype(float), total.astype(float)
        for i, (_, c, e) in enumerate(best):
            words[e] -= 1
            total[e] -= c
            self.weight[i] = c + 1
            if i >= OWN_CLASS:
                self.class_of[i] = group[e]
        self.weight[frequent : frequent + ENDINGS] = words + total + 1

    def pairs(self) -> Pairs:
        return Pairs(self.class_of, self.weight)


def _encode(blocks: DataFrame, counted: DataFrame, plan: Plan) -> DataFrame:
    """kind 0: documents with their codes and sums. kind 3: a block's counts of (history, class) for one
    shard, or of (code, next code) for one of as many more shards."""

    def vocabulary(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, codes = [], []
        for data in parts:
            c, e, marked, h = _unpack(data, "<i8", "u1", "<i4", "<u8")
            code = plan.size.frequent + e.astype(np.int64)
            for i, x in zip(marked, h.view(np.int64)):
                code[i] = plan.code.get(int(x), code[i])
            counts.append(c)
            codes.append(code)
        return np.concatenate(counts), np.concatenate(codes).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ready, seen = None, [], None, []

        def close() -> Iterator[pa.RecordBatch]:
            if seen:
                for kind, (keys, n) in enumerate(_added(seen)):
                    shard = keys // (CLASSES if not kind else plan.size.codes) % SHARDS + SHARDS * kind
                    yield _rows([(now, 3, int(s), None, None, _pack_counts(keys[shard == s], n[shard == s])) for s in np.unique(shard)])

        for batch in batches:
            out, fresh = [], []
            for block, kind, doc_id, held, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if block != now:
                    if fresh:
                        seen.append(_tally(fresh, plan))
                        fresh = []
                    yield from close()
                    now, parts, ready, seen = block, [], None, []
                if kind == 1:
                    parts.append(data)
                    continue
                if ready is None:
                    counts, codes = vocabulary(parts)
                    base = np.log10(counts + 1.0)
                    inside = np.where(codes < plan.size.frequent, 0.0, base - np.log10(plan.weight[codes]))
                    ready, parts = (counts > 0, base, inside, codes), []
                known, base, inside, codes = ready
                ids = _unpack(data, "<i4")[0]
                sums = np.array([len(ids), known[ids].sum(), base[ids].sum(), inside[ids].sum()])
                out.append((block, 0, -1, doc_id, held, _pack(codes[ids], sums)))
                if not held:
                    fresh.append(codes[ids])
            if fresh:
                seen.append(_tally(fresh, plan))
            if len(seen) > 16:
                seen = [_added(seen)]
            yield _rows(out)
        yield from close()

    both = blocks.where("kind = 0").unionByName(counted.where("kind = 1"))
    return both.repartition("block").sortWithinPartitions("block", F.desc("kind"), "bucket").mapInArrow(run, _LAYOUT)


def _histories(codes: np.ndarray, every: int) -> np.ndarray:
    """A document's histories: (two before) * every + (one before), every being the number of codes."""
    before = np.concatenate([[every - 1, every - 1], codes.astype(np.int64)])
    return before[:-2] * every + before[1:-1]


Counts = tuple[np.ndarray, np.ndarray]


def _tally(docs: list[np.ndarray], plan: Plan) -> tuple[Counts, Counts]:
    """Counts of history * CLASSES + class, and of code * codes + next code."""
    every = plan.size.codes
    histories, codes = np.concatenate([_histories(c, every) for c in docs]), np.concatenate(docs)
    return np.unique(histories * CLASSES + plan.class_of[codes], return_counts=True), np.unique(histories % every * every + codes, return_counts=True)


def _merge(seen: list[Counts]) -> Counts:
    keys, at = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in seen])).astype(np.int64)


def _added(seen: list[tuple[Counts, Counts]]) -> tuple[Counts, Counts]:
    return _merge([a for a, _ in seen]), _merge([b for _, b in seen])


def _shards(encoded: DataFrame) -> DataFrame:
    """One row for each shard: its counts in all blocks. A task adds up FAN parts of a shard at a time, until one is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([_pack_counts(*sums)], pa.binary())], names=["shard", "part", "data"])

        for batch in batches:
            for shard, part, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                new = _unpack_counts(data)
                if (shard, part) != now:
                    if now:
                        yield out()
                    now, sums = (shard, part), new
                else:
                    sums = _merge([sums, new])
        if now:
            yield out()

    counts = encoded.where("kind = 3").select(F.col("bucket").alias("shard"), F.col("block").alias("part"), "data")
    blocks = counts.select("part").distinct().count()
    # parts are dealt by a hash into as many as give FAN of them to a task; at the end there is one
    while True:
        groups = max(1, -(-blocks // FAN))
        counts = counts.withColumn("part", F.pmod(F.xxhash64("part", F.lit(groups)), F.lit(groups)))
        counts = counts.repartition(max(SHARDS, 8 * groups), "shard", "part").sortWithinPartitions("shard", "part").mapInArrow(run, "shard int, part long, data binary")
        counts = checkpointed(counts)
        if groups <= 1:
            return counts.select("shard", "data")
        blocks = groups


class Pairs:
    """P(code | class, code before): softmax within each class."""

    def __init__(self, class_of: np.ndarray, weight: np.ndarray) -> None:
        self.order = np.argsort(class_of, kind="stable")
        sorted_classes = class_of[self.order]
        self.start = np.flatnonzero(np.concatenate([[True], sorted_classes[1:] != sorted_classes[:-1]]))
        self.length = np.diff(np.append(self.start, len(class_of)))
        self.bias = np.log(weight)

    def _by_class(self, x: np.ndarray) -> np.ndarray:
        """Sums over each code's class, for each code."""
        out = np.empty_like(x)
        out[:, self.order] = np.repeat(np.add.reduceat(x[:, self.order], self.start, axis=1), self.length, axis=1)
        return out

    def p(self, w: np.ndarray) -> np.ndarray:
        z = np.exp(np.clip(self.bias + w, -60, 60))
        return z / self._by_class(z)

    def gradient(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of counts (code before x code) less the ridge, and a scale for steps."""
        p, total = self.p(w), self._by_class(n)
        return n - total * p - PAIR_RIDGE * w, np.maximum(total * p * (1 - p), 0.5 * n) + PAIR_RIDGE

    def fitted(self, n: np.ndarray, rounds: int = PAIR_ROUNDS) -> np.ndarray:
        """Natural logs of P after gradient updates on these counts."""
        w = np.zeros(n.shape)
        for _ in range(rounds):
            g, d = self.gradient(w, n)
            w += 0.7 * np.clip(g / d, -2, 2)
        return np.log(self.p(w))


def _pair_logs(shards: DataFrame, plan: Plan) -> np.ndarray:
    """Codes x codes: log P(code | class, code before), at most (MOST_FREQUENT + ENDINGS + 1)^2 numbers."""
    every, pairs = plan.size.codes, plan.pairs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                keys, n = _unpack_counts(data)
                before, at = np.unique(keys // every, return_inverse=True)
                for a in range(0, len(before), 64):
                    mine = (at >= a) & (at < a + 64)
                    counts = np.zeros((len(before[a : a + 64]), every))
                    counts[at[mine] - a, keys[mine] % every] = n[mine]
                    logs = pairs.fitted(counts).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(before[a : a + 64]), pa.array([_pack(x) for x in logs], pa.binary())], names=["before", "logs"])

    out = np.repeat(np.log(pairs.p(np.zeros((1, every)))).astype(np.float32), every, axis=0)
    for r in shards.where(F.col("shard") >= SHARDS).select("data").mapInArrow(run, "before long, logs binary").toLocalIterator():
        out[r["before"]] = _unpack(r["logs"], "<f4")[0]
    return out


class Weights:
    """A bias and three tables of feature weights by class."""

    def __init__(self, size: Size = Size(), flat: np.ndarray | None = None) -> None:
        self.size = size
        self.flat = np.zeros((size.rows, CLASSES), dtype=np.float32) if flat is None else flat

    def rows(self, histories: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of the flat table for each history's features."""
        codes = self.size.codes
        skip, last = histories // codes, histories % codes
        mixed = (histories.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        return 1 + last, 1 + codes + skip, 1 + 2 * codes + (mixed % np.uint64(self.size.trigrams)).astype(np.int64)

    def log_p(self, histories: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history), histories x classes."""
        a, b, c = self.rows(histories)
        z = self.flat[a] + self.flat[b] + self.flat[c] + self.flat[0]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _gradient(weights: Weights, keys: np.ndarray, n: np.ndarray, total: Counts | None = None) -> Counts:
    """Gradient of the log likelihood, and a scale for steps (diagonal curvature), both of the weights' shape, added to
    `total`."""
    g, d = total or (np.zeros(weights.flat.shape), np.zeros(weights.flat.shape))
    history = keys // CLASSES
    distinct, start = np.unique(history, return_index=True)
    ends = np.append(start[1:], len(keys))
    for a in range(0, len(distinct), 4096):
        h = distinct[a : a + 4096]
        lo, hi = start[a], ends[min(a + 4096, len(distinct)) - 1]
        seen = np.zeros((len(h), CLASSES))
        seen[np.searchsorted(h, history[lo:hi]), keys[lo:hi] % CLASSES] = n[lo:hi]
        p = np.exp(weights.log_p(h).astype(np.float64))
        tokens = seen.sum(axis=1, keepdims=True)
        # curvature here or, where the class is far more frequent than p says, about where the step leads
        error, curve = seen - tokens * p, np.maximum(tokens * p * (1 - p), 0.5 * seen)
        g[0] += error.sum(axis=0)
        d[0] += curve.sum(axis=0)
        for rows in weights.rows(h):
            order = np.argsort(rows, kind="stable")
            r, first = np.unique(rows[order], return_index=True)
            g[r] += np.add.reduceat(error[order], first, axis=0)
            d[r] += np.add.reduceat(curve[order], first, axis=0)
    return g, d


def train(shards: DataFrame, size: Size = Size(), rounds: int = ROUNDS, step: float = 0.3, ridge: float = RIDGE) -> tuple[Weights, list[float]]:
    """Gradient updates on the counts of the whole corpus. A task returns sums of the weights' size, whatever its
    shards hold; there are at most UPDATE_TASKS tasks, and their sums are added up by slices of the weights."""
    sc = shards.sparkSession.sparkContext
    weights = Weights(size)
    norms: list[float] = []
    edges = np.linspace(0, size.rows, SLICES + 1).astype(int)
    histories = shards.where(F.col("shard") < SHARDS).select("data")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = [a.astype(np.float64) for a in _unpack(data.as_py(), "<f4", "<f4")]
                sums[k] = [a + b for a, b in zip(sums[k], new)] if k in sums else new
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(*(a.astype(np.float32) for a in total))], pa.binary())], names=["slice", "data"])

    for _ in range(rounds):
        shared = sc.broadcast(weights.flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, total = Weights(size, shared.value), None
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    total = _gradient(w, *_unpack_counts(data), total)
            if total is not None:
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(total[0][a:b].astype(np.float32), total[1][a:b].astype(np.float32))], pa.binary())], names=["slice", "data"])

        layout = "slice int, data binary"
        # rows of bounded size, added up before one of each slice reaches the driver
        got = histories.coalesce(UPDATE_TASKS).mapInArrow(run, layout).repartition(SLICES, "slice").mapInArrow(added, layout).collect()
        shared.unpersist()
        if not got:
            break
        after = weights.flat.copy()
        norm = 0.0
        for r in got:
            a, b = edges[r["slice"]], edges[r["slice"] + 1]
            slope, scale = (x.astype(np.float64).reshape(b - a, CLASSES) for x in _unpack(r["data"], "<f4", "<f4"))
            g = slope - ridge * weights.flat[a:b]
            norm += float(np.abs(g).sum())
            after[a:b] += step * np.clip(g / (scale + ridge), -2, 2)
        norms.append(norm)
        weights = Weights(size, after)
    return weights, norms


def _scored(encoded: DataFrame, plan: Plan, weights: Weights, pair_logs: np.ndarray) -> DataFrame:
    sc = encoded.sparkSession.sparkContext
    shared, logs_of_pairs = sc.broadcast(weights.flat), sc.broadcast(pair_logs)
    floor = np.log10(plan.n + 1.0 * (plan.v + 1))
    every = plan.size.codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pairs = Weights(plan.size, shared.value), logs_of_pairs.value
        for batch in batches:
            out = []
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for at in range(0, len(rows), 256):
                docs = [_unpack(data, "<u2", "<f8") for _, _, data in rows[at : at + 256]]
                histories = np.concatenate([_histories(c, every) for c, _ in docs])
                distinct, where = np.unique(histories, return_inverse=True)
                codes = np.concatenate([c for c, _ in docs])
                classes = plan.class_of[codes]
                logs = np.empty(len(histories))
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(0, len(distinct) + 8192, 8192))
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if a < b:
                        part = order[a:b]
                        logs[part] = w.log_p(distinct[k * 8192 : (k + 1) * 8192])[where[part] - k * 8192, classes[part]]
                logs += pairs[histories % every, codes]
                ends = np.cumsum([len(c) for c, _ in docs])
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[np.concatenate([[0], ends])])
                for (doc_id, held, _), (_, s), z in zip(rows[at : at + 256], docs, sums):
                    out.append((doc_id, held, int(s[0]), int(s[1]), plan.n, float(s[2] - s[0] * floor), float(z / _LOG10 + s[3])))
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.where("kind = 0").select("doc_id", "held_out", "data").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (the model's), in log10."""
    chosen = docs.select("doc_id", "text")
    buckets = max(32, 4 * chosen.rdd.getNumPartitions())  # a bucket's words stay as few however many blocks there are
    blocks = checkpointed(_blocks(chosen, buckets))
    counted = checkpointed(_count(blocks.where("kind = 1"), buckets))
    plan = Plan(*_summary(counted))
    encoded = checkpointed(_encode(blocks, counted, plan))
    shards = _shards(encoded)
    weights, _ = train(shards, plan.size, rounds)
    return _scored(encoded, plan, weights, _pair_logs(shards, plan))
