"""Block-max search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c, n in counted:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scored)[:top], 1)]
    return out


def rows(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Äpfel", "ÄPFEL", "x1Y", "naïve"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(r.choices(words, weights, k=r.randint(1, 80))) for _ in range(600)]
    texts += [texts[3]] * 40 + [None, "", " .,! ", "W1-w2_w3\x7fw4", "w5 " * 30_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3]), (-5, texts[3])]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(40)] + [(100, texts[3]), (100, texts[3]), (101, None), (102, "--"), (103, "unknown"), (104, "w1 " * 50), (None, "w2 Äpfel")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, made):
    docs, items = made
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score long").repartition(6), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")


def test_terms_are_those_of_the_pattern():
    every = "".join(chr(c) for c in range(0x250)) + "aÉ😀Z"
    assert [t.decode() for t in lexical.terms(every.encode())] == plain_terms(every)


@pytest.mark.parametrize("block_docs", [2048, 16])
def test_search_is_the_plain_ranking(spark, monkeypatch, made, frames, block_docs):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    got = Counter(rows(lexical.search(*frames)))
    assert got == Counter(plain(*made, 20))


def test_groups_of_queries_give_the_same(made, frames):
    assert Counter(rows(lexical.search(*frames, top=5, most_terms=300))) == Counter(plain(*made, 5))


def test_ranks_are_one_to_n_and_best_first(frames):
    by = {}
    for item, rank, _, score in rows(lexical.search(*frames)):
        if item not in (100, None):
            by.setdefault(item, []).append((rank, score))
    for found in by.values():
        found.sort()
        assert [r for r, _ in found] == list(range(1, len(found) + 1))
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_bounds_hold_and_blocks_are_left_out(made):
    """A block's bound is never below its best score, and with a threshold many blocks need no scores."""
    docs, items = made
    wanted = [t for i, t in items if i is not None and plain_terms(t)]
    vocabulary = sorted({t.encode() for x in wanted for t in plain_terms(x)})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = [np.unique([number[t.encode()] for t in plain_terms(x)], return_counts=True) for x in wanted]
    df = Counter(t for _, x in docs for t in {w.encode() for w in plain_terms(x)} if t in number)
    q = lexical.Queries(np.cumsum([0, *[len(t) for t, _ in counted]]), np.concatenate([t for t, _ in counted]), np.concatenate([n for _, n in counted]), np.array([int(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in vocabulary]), len(docs), sum(len(plain_terms(t)) for _, t in docs), 20)
    blocks = []
    for at in range(0, len(docs), 16):
        b = lexical.Block()
        for doc_id, text in docs[at : at + 16]:
            b.add(doc_id, (text or "").encode(), number)
        if b.ids:
            row = dict(zip(lexical._INDEX_NAMES, b.close(at)))
            blocks.append(lexical.Read.of(row, q))
    times, scored = np.zeros(len(vocabulary), dtype=np.int64), 0
    bounds = np.array([q.bounds(b.term, b.parts) for b in blocks])
    for k in range(len(q)):
        scores = [b.scores(q, k, times) for b in blocks]
        assert all(bounds[i, k] >= s.max() for i, s in enumerate(scores))
        threshold = np.sort(np.concatenate(scores))[-20]
        scored += (bounds[:, k] >= max(1, threshold)).sum()
    assert scored < 0.8 * bounds.size


def test_empty_tables(spark, frames):
    docs, items = frames
    assert rows(lexical.search(docs.limit(0), items)) == rows(lexical.search(docs, items.limit(0))) == []
    assert lexical.search(docs, items.limit(0)).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
