"""Language identification with interpolated Kneser-Ney models of characters, one for each language.

A text is seen as its letters in lower case, all else being one space between words. Its characters are numbers of an alphabet
of at most ALPHABET symbols (rarer ones share a number), so that ORDER of them fit into one 64-bit number.

1. Spark counts the n-grams of the highest order, by language, in a sample of the labelled documents: about SAMPLE_ROWS of each
   language, picked by a hash (the bounded sample of a classifier; all others count nowhere). Counts of lower orders are
   continuations: how many symbols an n-gram follows. The table that reaches the driver is bounded by CELLS: where there
   are more n-grams and languages, the rarest n-grams of the highest order go.
2. For each order, the n-grams that any language has are one array sorted by hash, with a row of log probabilities, one for each
   language, and the contexts another one with the weights of falling back. A character's probabilities are found with one
   look-up where its n-gram is known, else with a look-up of its context and those of the next lower order.
3. The language with the least cross-entropy a character is the prediction. How far the next one is behind, a character and in
   all, is calibrated by a logistic fit on other labelled documents (CALIBRATION_ROWS at most, about): `score` is the
   probability that the prediction is right. Below the least score at which no more than WRONG of the accepted ones are
   wrong, `rejected` is set.

Documents are scored in numpy batches of bounded size; nothing is shuffled but n-gram counts.

Cases: a null text, or one without a letter, is `und` with score 0 and rejected; without any labelled document all are;
labels null are no labels, the empty string is one; with one language only it is compared with even odds for all symbols; texts of
any length are scored whole (a batch may exceed BATCH_CHARS by one document); equal cross-entropies go to the language that is
first by name; repeated rows are alike; null keys are rows like others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ORDER, BITS = 5, 12
ALPHABET = 1 << BITS
SAMPLE_ROWS, CALIBRATION_ROWS = 3000, 4000
#: Numbers of the model at most: (n-grams + contexts) x languages, of all orders together about twice those of the highest.
CELLS = 12_000_000
BATCH_CHARS = 1_000_000
WRONG = 0.01
RIDGE = 1e-2
UNDETERMINED = "und"

_MASK = [np.int64((1 << (BITS * k)) - 1) for k in range(ORDER + 1)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAD = " " * (ORDER - 1)
SCHEMA = "lang_pred string, score double, rejected boolean, letters long, cross_entropy double"


def letters(text: Column) -> Column:
    """A text's letters in lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


class Hashed:
    """Rows found by 64-bit keys: keys are mixed one to one, sorted, and found from where their first bits point to."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        mixed = self._mixed(keys)
        order = np.argsort(mixed)
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(mixed[order] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.hashes = np.append(mixed[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = rows[order]

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * _MIX
        return (h ^ (h >> np.uint64(32))) * _MIX

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's row is, and whether it is there."""
        h = self._mixed(keys)
        at = self.start[h >> self.shift]
        there = self.hashes[at]
        found = there == h
        todo = np.flatnonzero(there < h)
        while len(todo):
            at[todo] += 1
            there, wanted = self.hashes[at[todo]], h[todo]
            found[todo] = there == wanted
            todo = todo[there < wanted]
        # the last hash can be the sentinel's own: it has no row
        found &= at < len(self.rows)
        return at, found


@dataclass
class Model:
    """languages; number of each code point; log probabilities of single symbols; and for each order from 2 on the known
    n-grams and contexts. calibration: weights of the logistic fit; least: the score below which a prediction is rejected."""

    languages: list[str]
    number: np.ndarray
    single: np.ndarray
    grams: list[Hashed]
    contexts: list[Hashed]
    calibration: np.ndarray
    least: float = 0.0

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """For n-grams of `order` symbols the log probability of the last one after the others, in each language."""
        if order == 1:
            return self.single[keys]
        at, found = self.grams[order - 2].find(keys)
        out = np.empty((len(keys), len(self.languages)), dtype=np.float32)
        out[found] = self.grams[order - 2].rows[at[found]]
        missing = np.flatnonzero(~found)
        if len(missing):
            lower = self.log_probabilities(keys[missing] & _MASK[order - 1], order - 1)
            at, found = self.contexts[order - 2].find(keys[missing] >> BITS)
            lower[found] += self.contexts[order - 2].rows[at[found]]
            out[missing] = lower
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each text, and its log probability in each language."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        keys = grams(self.number, texts)
        logs = self.log_probabilities(keys)
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            total[some] = np.add.reduceat(logs, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return sizes, total

    def margins(self, sizes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language of each text, its cross-entropy a symbol, and how much more the next one's is."""
        entropy = -total / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1)
        if len(self.languages) > 1:
            two = np.partition(entropy, 1, axis=1)
            return best, two[:, 0], two[:, 1] - two[:, 0]
        return best, entropy[:, 0], np.log(ALPHABET) - entropy[:, 0]

    def score(self, sizes: np.ndarray, margin: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-features(sizes, margin) @ self.calibration))


def features(sizes: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sizes)), np.log1p(np.maximum(0, margin) * sizes), np.maximum(0, margin)], axis=1)


def grams(number: np.ndarray, texts: list[str]) -> np.ndarray:
    """The n-grams that end at each symbol of the texts, each text on its own after as many spaces as a context has."""
    raw = "".join(_PAD + t for t in texts)
    symbols = number[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
    if not len(symbols):
        return symbols
    keys = symbols.copy()
    for k in range(1, ORDER):
        keys[k:] |= symbols[:-k] << (BITS * k)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return keys[np.arange(sizes.sum()) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), sizes)]


def _cut(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about `most` characters, with the place of the first."""
    at, held, size = 0, [], 0
    for x in texts:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _alphabet(sample: DataFrame) -> np.ndarray:
    """The number of each code point: the most frequent are 1, 2, ... by frequency, then code point; all others are 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _cut(batch.column(0), BATCH_CHARS):
                points, n = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int32)), pa.array(n)], names=["point", "n"])

    found = sample.select("text").mapInArrow(count, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    number = np.zeros(0x110000, dtype=np.uint16)
    for i, r in enumerate(found.orderBy(F.desc("n"), "point").limit(ALPHABET - 2).collect()):
        number[r["point"]] = i + 1
    number[ord(" ")] = number[ord(" ")] or ALPHABET - 1
    return number


def _counts(sample: DataFrame, number: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Language, n-gram and count of the highest order, and for each language how many n-grams occur once and twice."""
    shared = sample.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column(0).to_numpy()
            for at, texts in _cut(batch.column(1), BATCH_CHARS):
                keys = grams(shared.value, texts)
                of = np.repeat(language[at : at + len(texts)], [len(t) for t in texts])
                for k in np.unique(of):
                    gram, n = np.unique(keys[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, dtype=np.int32)), pa.array(gram), pa.array(n)], names=["language", "gram", "n"])

    counted = sample.select("language", "text").mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).cache()
    often = counted.groupBy("language", F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("grams")).collect()  # 1000 rows a language at most
    few = {(r["language"], r["n"]): r["grams"] for r in often if r["n"] < 3}
    languages = len({r["language"] for r in often})
    least = next((c for c in range(1, 1001) if 2 * languages * sum(r["grams"] for r in often if r["n"] >= c) <= cells), 1001)
    rows = counted.where(F.col("n") >= least).toArrow()
    counted.unpersist()
    return *(rows.column(c).to_numpy() for c in ("language", "gram", "n")), few


def kneser_ney(language: np.ndarray, gram: np.ndarray, n: np.ndarray, few: dict, languages: int) -> tuple[np.ndarray, list[Hashed], list[Hashed]]:
    """Log probabilities of single symbols, and of the known n-grams and contexts of each order from 2 on, from the counts of
    the highest order; those of lower orders are continuation counts, and each order has one discount a language."""
    levels = {ORDER: (language.astype(np.int64), gram, n.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):
        of, keys, _ = levels[k + 1]
        both, count = np.unique(np.stack([of, keys & _MASK[k]]), axis=1, return_counts=True)
        levels[k] = both[0], both[1], count.astype(np.float64)
    every, base = np.arange(ALPHABET, dtype=np.int64), np.full((ALPHABET, languages), 1 / ALPHABET)
    below, single, grams_, contexts = np.zeros(ALPHABET, dtype=np.int64), None, [], []
    for k in range(1, ORDER + 1):
        of, keys, count = levels[k]
        if k > 1:
            every, known = np.unique(keys), every
            below = np.searchsorted(known, every & _MASK[k - 1])
            base = p[below]  # noqa: F821 (of the order before)
        p = base.copy()
        context = np.unique(keys >> BITS)
        weight = np.ones((len(context), languages))
        for j in range(languages):
            mine = of == j
            if not mine.any():
                continue
            c, g = count[mine], keys[mine]
            once, twice = (few.get((j, 1), 0), few.get((j, 2), 0)) if k == ORDER else ((c == 1).sum(), (c == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            at = np.searchsorted(context, g >> BITS)
            total, kinds = np.bincount(at, c, len(context)), np.bincount(at, minlength=len(context))
            seen = total > 0
            weight[seen, j] = discount * kinds[seen] / total[seen]
            p[:, j] *= np.where(np.isin(every >> BITS, context[seen]), weight[np.searchsorted(context, every >> BITS).clip(0, len(context) - 1), j], 1.0)
            p[np.searchsorted(every, g), j] += np.maximum(c - discount, 0) / total[at]
        logs = np.log(p).astype(np.float32)
        if k == 1:
            single = logs
        else:
            grams_.append(Hashed(every, logs))
            contexts.append(Hashed(context, np.log(weight).astype(np.float32)))
    return single, grams_, contexts


def _logistic(x: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * len(x) * np.eye(len(w)) / 100, x.T @ (right - p) - RIDGE * len(x) * w / 100)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, label: str, text: str = "text", key: str = "doc_id", cells: int = CELLS) -> Broadcast:
    """A model of the languages in `label` of docs; rows without a label take no part."""
    spark = docs.sparkSession
    known = docs.where(F.col(label).isNotNull())
    rows = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    names = sorted(rows)
    model = Model(names, np.zeros(0x110000, dtype=np.uint16), np.zeros((ALPHABET, len(names)), dtype=np.float32), [], [], np.array([0.0, 1.0, 0.0]))
    if names:
        share = spark.createDataFrame([(name, i, min(1.0, SAMPLE_ROWS / (0.875 * rows[name])), min(1.0, CALIBRATION_ROWS / (0.125 * sum(rows.values())))) for i, name in enumerate(names)], f"`{label}` string, language int, fit double, check double")
        h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), text)
        picked = known.select(label, text, h.alias("h")).join(F.broadcast(share), label)
        u = F.pmod(F.shiftright("h", 3), F.lit(1 << 20)) / F.lit(float(1 << 20))
        checks = F.pmod("h", F.lit(8)) == 0
        picked = picked.where(F.when(checks, u < F.col("check")).otherwise(u < F.col("fit"))).select("language", checks.alias("checks"), letters(F.col(text)).alias("text")).cache()
        sample = picked.where(~F.col("checks"))
        model.number = _alphabet(sample)
        language, gram, n, few = _counts(sample, model.number, cells)
        model.single, model.grams, model.contexts = kneser_ney(language, gram, n, few, len(names))
        _calibrate(model, picked.where("checks AND length(text) > 0"))
        picked.unpersist()
    return spark.sparkContext.broadcast(model)


def _calibrate(model: Model, sample: DataFrame) -> None:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column(0).to_numpy()
            for at, texts in _cut(batch.column(1), BATCH_CHARS // len(shared.value.languages)):
                sizes, total = shared.value.sums(texts)
                best, _, margin = shared.value.margins(sizes, total)
                yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(margin), pa.array(best == language[at : at + len(texts)])], names=["sizes", "margin", "right"])

    told = sample.select("language", "text").mapInArrow(tell, "sizes long, margin double, right boolean").toArrow()  # about CALIBRATION_ROWS
    if told.num_rows:
        sizes, margin, right = (told.column(c).to_numpy() for c in ("sizes", "margin", "right"))
        model.calibration = _logistic(features(sizes, margin), right.astype(float))
        score = model.score(sizes, margin)
        order = np.argsort(-score, kind="stable")
        wrong = np.cumsum(~right[order])
        good = np.flatnonzero(wrong <= WRONG * np.arange(1, len(order) + 1))
        model.least = float(score[order][good[-1]]) if len(good) else 1.0
    shared.destroy()


def predict(docs: DataFrame, columns: list[str], model: Broadcast, text: str = "text") -> DataFrame:
    """`columns` of docs with the language of each text, how sure it is, whether it is rejected as not sure enough, and the
    cross-entropy a letter."""
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("any"), letters(F.col(text)).alias("text"))
    schema = StructType([chosen.schema["row"], *StructType.fromDDL(SCHEMA).fields])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            some = batch.column(1).to_numpy(zero_copy_only=False)
            for at, texts in _cut(batch.column(2), BATCH_CHARS // max(1, len(m.languages))):
                row, sizes = batch.column(0).slice(at, len(texts)), np.array([len(t) for t in texts], dtype=np.int64)
                known = some[at : at + len(texts)] & bool(m.languages)
                names, score, entropy = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts)), np.full(len(texts), np.nan)
                if m.languages:
                    sizes, total = m.sums(texts)
                    best, entropy, margin = m.margins(sizes, total)
                    score = np.where(known, m.score(sizes, margin), 0.0)
                    names = np.where(known, np.array(m.languages, dtype=object)[best], UNDETERMINED)
                out = [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(~known | (score < m.least)), pa.array(sizes), pa.array(np.where(known, entropy, 0.0), mask=~known)]
                yield pa.RecordBatch.from_arrays([row, *out], names=schema.names)

    return chosen.mapInArrow(tell, schema).select("row.*", *StructType.fromDDL(SCHEMA).names)
