"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of open bins, found through a bitset over their free space; a piece
goes into the fullest bin that holds it; if none does and no bin may be opened, the fullest bin closes first.
Each partition packs its own pieces with bins of its own, so nothing is collected; what stays open at the end of a
partition is at most `open_bins` sequences against PIECES_PER_TASK pieces.

Cases: null text is empty and still has its end id; only pieces longer than a sequence are cut; null, equal or
repeated doc_ids are packed row by row; ties between bins go to the last one opened; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_TOKENS = 2048
OPEN_BINS = 2048
#: Pieces that one packing task takes; more pieces give more tasks, never larger ones.
PIECES_PER_TASK = 250_000
#: Entries after which a worker's word cache starts anew.
CACHE_WORDS = 2_000_000
END_ID = 0
_END = END_ID.to_bytes(4, "little")

_TOKENIZERS: dict[str, "CachedTokenizer"] = {}


class CachedTokenizer:
    """A tokenizer file applied word by word with a cache of words.

    For tokenizers like `word_bpe_49k.json`: lower case, pre-tokens that are runs of letters or of marks and never span
    white space, and word-end marks on a pre-token's last id. The ids of a text are then those of its words in order.
    A word seen before costs one look-up. New words of Latin letters are encoded many at a time, as lower-case words
    with a space between, and told apart by the word-end marks; all others go through the whole tokenizer one by one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.most = CACHE_WORDS
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> "CachedTokenizer":
        if path not in _TOKENIZERS:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the threads
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def learn(self, words: set[str]) -> None:
        """Put the words into the cache. Letters followed by ASCII marks are two parts."""
        cache, parts, plain, whole = self.cache, [], {}, {}
        for w in words:
            if m := _LATIN(w):
                stem, marks = m.group(1).lower(), m.group(2)
                if stem not in cache:
                    plain[stem] = None
                if marks and marks not in cache:
                    whole[marks] = None
                if stem != w:
                    parts.append((w, stem, marks))
            else:
                whole[w] = None
        stems = list(plain)
        for at in range(0, len(stems), 512):
            some = stems[at : at + 512]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            data, cuts = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer's ids can't be told apart by word ends")
            start = 0
            for w, end in zip(some, cuts):
                cache[w] = data[start:end]
                start = end
        for w, e in zip(whole, self.tokenizer.encode_batch_fast(list(whole), add_special_tokens=False)):
            cache[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, stem, marks in parts:
            cache[w] = cache[stem] + cache[marks] if marks else cache[stem]

    def data(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        texts = [_words(t) for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        if missing := set(chain.from_iterable(texts)).difference(self.cache):
            self.learn(missing)
        for words in texts:
            yield b"".join(map(self.cache.__getitem__, words))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(next(self.data([text])), dtype="<u4").tolist()


#: Latin letters whose lower case and composed form do not depend on their neighbours, then ASCII marks.
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-įĴ-ňŊ-ſ]+)([!-/:-@\\[-`{-~]*)").fullmatch


def _words(text: str) -> list[str]:
    """Runs of anything but the six ASCII white-space characters."""
    for c in "\t\n\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _encoded(encoder: CachedTokenizer, column: pa.Array, chars: int = 1_000_000) -> Iterator[bytes]:
    """The ids of a column's texts, some texts at a time."""
    some, size = [], 0
    for x in column:
        some.append(x.as_py() or "")
        size += len(some[-1])
        if size >= chars:
            yield from encoder.data(some)
            some, size = [], 0
    yield from encoder.data(some)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's ids and its end id, cut only
    where longer than max_tokens. No shuffle. A worker's word cache
    starts anew beyond cache_words words (about 200 bytes each), which it keeps while it lives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedTokenizer.of(tokenizer)
        encoder.most = cache_words
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, found in enumerate(_encoded(encoder, batch.column(1))):
                data = np.frombuffer(found + _END, dtype="<u4")
                for k, at in enumerate(range(0, len(data), max_tokens)):
                    part = data[at : at + max_tokens]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class OpenBins:
    """The open sequences of one task."""

    def __init__(self, capacity: int, most: int, first_id: int) -> None:
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.free = 0  # bit f is set while some open bin has f tokens free
        self.by_free: dict[int, list[int]] = {}
        self.open = 0

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << free)
        self.open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece."""
        if fitting := self.free >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self.take(free)
        else:
            if self.open >= self.most:
                self.take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            free, sequence = self.capacity, self.next_id
            self.next_id += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """cut (doc_id, piece, length and others; each length at most max_tokens) with sequence_id and offset."""
    cut = checkpointed(cut)  # the tokens are counted once, also if an executor is lost
    tasks = max(1, -(-cut.count() // pieces_per_task))
    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(max_tokens, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, cut.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (packed must have ids): sequence_id, ids, and doc_id and length of each piece
    in order. A group holds one sequence, so at most max_tokens ids."""
    entry = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(entry.alias("e")).select("sequence_id", F.flatten("e.ids").alias("ids"), F.col("e.doc_id").alias("doc_ids"), F.col("e.length").alias("lengths"))
