import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrid.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbé'sß.,!? \n\t0123²ǅ́ \x1c<|>"), st.characters(codec="utf-8")), max_size=60))
def test_word_cache_equals_the_tokenizer(text):
    assert list(packing.CachedTokenizer.of(PATH).ids(text)) == PLAIN.encode(text, add_special_tokens=False).ids


def expected(rows, size):
    out = []
    for i, t in rows:
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), size)):
            p = np.array(ids[at : at + size], dtype="<u4")
            out.append((i, k, at, len(p), zlib.crc32(p.tobytes())))
    return sorted(out, key=str)


def test_pack(docs, doc_rows):
    got = packing.pack(packing.pieces(docs, PATH, with_ids=False), pieces_per_task=40).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == expected(doc_rows, 2048)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 2048) + 3


def test_sequences_hold_the_ids(docs):
    packed = packing.pack(packing.pieces(docs, PATH))
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == sum(r["lengths"]) <= 2048


def test_bounded_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    assert bins.place(6) == (3, 0) and bins.open <= 2


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(none, PATH, with_ids=False)).count() == 0


def plain_best_fit(lengths, capacity, most):
    """Sequence and offset of each piece: the open bin with the least room that suffices, of several the one that came to have
    it last; where none suffices a new one, for which the fullest closes if `most` are open."""
    bins, out, clock = [], [], 0  # [free, when, sequence]
    sequences = 0
    for n in lengths:
        clock += 1
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            b = min(fitting, key=lambda b: (b[0], -b[1]))
            bins.remove(b)
        else:
            if len(bins) >= most:
                bins.remove(min(bins, key=lambda b: (b[0], -b[1])))
            b = [capacity, clock, sequences]
            sequences += 1
        out.append((b[2], capacity - b[0]))
        if b[0] > n:
            bins.append([b[0] - n, clock, b[2]])
    return out


@pytest.mark.parametrize("most", [1, 4, 64])
def test_placement_is_the_plain_best_fit(docs, most):
    """All sequences of a whole table against a list of bins, pieces in the order in which the task has them."""
    cut = packing.pieces(docs, PATH, max_tokens=97, with_ids=False)
    got = packing.pack(cut, max_tokens=97, open_bins=most).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["ids_crc32"])  # noqa: E731  nulls first
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    assert [(r["sequence_id"], r["offset"]) for r in got] == plain_best_fit([r["length"] for r in got], 97, most)
    assert len({r["sequence_id"] for r in got}) > most
