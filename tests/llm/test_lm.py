import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import lm


def split(text):
    import re

    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def base(rows):
    train = Counter(t for i, x in rows if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2 for t in split(x))
    n, v = sum(train.values()), len(train)
    out = []
    for i, x in rows:
        t = split(x)
        out.append((i, zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2, len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), 6)))
    return sorted(out, key=str)


def test_base_equals_plain_counts(docs, doc_rows):
    got = lm.score_documents(docs.repartition(3), rounds=2).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == base(doc_rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.fixture(scope="module")
def order(spark):
    r = random.Random(6)
    after = {w: [f"{w}{x}" for x in "xyz"] for w in "abcdefgh"}
    rows = []
    for i in range(400):
        text = []
        for _ in range(60):
            w = r.choice("abcdefgh")
            text += [w, r.choice(after[w])]
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_model_learns_order_on_held_out_documents(order):
    held = lm.score_documents(order).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert held["s"] > held["b"] + 0.3


def a_plan():
    best = [(i, 50 - i % 50, i % lm.ENDINGS) for i in range(lm.LEAST_FREQUENT)]
    words, total = np.bincount([b[2] for b in best], minlength=lm.ENDINGS) + 3, np.bincount([b[2] for b in best], [b[1] for b in best], minlength=lm.ENDINGS).astype(int) + 9
    return lm.Plan(int(total.sum()), int(words.sum()), best, words, total)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    size = lm.Size()
    w = lm.Weights(size, r.normal(size=(size.rows, lm.CLASSES)).astype(np.float32))
    assert np.allclose(np.exp(w.log_p(np.arange(0, size.codes**2, 997))).sum(axis=1), 1, atol=1e-4)
    plan = a_plan()
    # codes within a class, after any code
    logs = plan.pairs().fitted(r.integers(0, 5, size=(3, size.codes)).astype(float))
    assert np.allclose([[np.exp(x[plan.class_of == k]).sum() for k in range(lm.CLASSES)] for x in logs], 1)
    # words within a code: three others of each ending with nine tokens, and one unknown
    assert np.allclose((9 + 3 + 1) / plan.weight[size.frequent : size.frequent + lm.ENDINGS], 1)


def test_gradient_is_the_slope():
    r = np.random.default_rng(3)
    size = lm.Size()
    keys = np.unique(r.integers(0, size.codes**2 * lm.CLASSES, size=400))
    n = r.integers(1, 9, size=len(keys))
    w = lm.Weights(size, (r.normal(size=(size.rows, lm.CLASSES)) * 0.1).astype(np.float32))
    like = lambda x: float((n * lm.Weights(size, x).log_p(keys // lm.CLASSES)[np.arange(len(keys)), keys % lm.CLASSES].astype(np.float64)).sum())
    g, _ = lm._gradient(w, keys, n)
    for i, k in [(0, 3), (int(w.rows(keys[:1] // lm.CLASSES)[0][0]), 5), (int(w.rows(keys[:1] // lm.CLASSES)[2][0]), 1)]:
        up, down = w.flat.copy(), w.flat.copy()
        up[i, k] += 0.05
        down[i, k] -= 0.05
        assert abs((like(up) - like(down)) / 0.1 - g[i, k]) < 0.05 * max(1, abs(g[i, k]))


def test_pair_gradient_is_the_slope_and_updates_end_there():
    r = np.random.default_rng(9)
    pairs = a_plan().pairs()
    n, w = r.integers(0, 4, size=(2, lm.Size().codes)).astype(float), r.normal(size=(2, lm.Size().codes)) * 0.2
    like = lambda x: float((n * np.log(pairs.p(x))).sum() - lm.PAIR_RIDGE * (x**2).sum() / 2)
    g, _ = pairs.gradient(w, n)
    for at in ((0, 50), (1, 7), (1, 600)):
        step = np.zeros_like(w)
        step[at] = 1e-4
        assert abs((like(w + step) - like(w - step)) / 2e-4 - g[at]) < 1e-4 * max(1, abs(g[at]))
    logs = pairs.fitted(n, 300)
    assert (n * logs).sum() > (n * np.log(pairs.p(np.zeros_like(n)))).sum()


def test_size_follows_the_corpus():
    assert [lm.Size.of(t).frequent for t in (0, 10**6, 17 * 10**6, 85 * 10**6, 10**9, 10**12)] == [512, 512, 512, 512, 1024, 2048]


def test_shards_add_up_many_blocks(spark):
    r = np.random.default_rng(2)
    rows, want = [], Counter()
    for block in range(lm.FAN * lm.FAN + 3):
        keys = np.unique(r.integers(0, 50, size=9))
        n = r.integers(1, 5, size=len(keys))
        rows.append((block, 3, block % 3, None, None, bytearray(lm._pack_counts(keys, n))))
        want.update({(block % 3, int(k)): int(c) for k, c in zip(keys, n)})
    got = Counter()
    for x in lm._shards(spark.createDataFrame(rows, lm._LAYOUT)).collect():
        assert not any(s == x["shard"] for s, _ in got)
        got.update({(x["shard"], int(k)): int(c) for k, c in zip(*lm._unpack_counts(bytes(x["data"])))})
    assert got == want


def test_scores_equal_a_plain_version(spark):
    """Few documents, no training: what is left of the model are shares, which plain Python can say."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choices([f"{x}{y}" for x in "abcdef" for y in "ghijk"], k=30))) for i in range(60)]
    got = {x["doc_id"]: x for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in split(x))
    ranked = sorted(train, key=lambda w: (w is not None, -train[w]))
    # the end token is the first class; all words are codes of their own, and all but the 40 first share ending classes
    assert len(train) <= lm.OWN_CLASS
    pairs = Counter((a, b) for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2 for a, b in zip([0, *split(x)], split(x)))
    assert pairs and ranked[0] is None
    for i, x in rows:
        # classes of one code: the class softmax alone, uniform without updates
        known = [w for w in split(x) if train[w]]
        if len(known) == len(split(x)):
            assert abs(got[i]["score"] - len(known) * math.log10(1 / lm.CLASSES)) < 1e-4


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
