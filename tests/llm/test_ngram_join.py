import random
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import ngram_join


def grams(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a & b and len(a & b) >= t * len(a | b)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return Counter((d, first.get(find(i)), links[i]) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    out, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(60):
        text = [word() for _ in range(r.randint(30, 200))]
        if r.random() < 0.5:
            text += passage
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = word()
            out.append((n := n + 1, " ".join(copy)))
    out += [(9000, None), (9001, ""), (9002, "one two"), (9003, "one two"), (9004, "one two three"), (None, "lonely text of no name at all"), (9005, out[0][1]), out[3], (None, out[0][1])]
    hot = [word() for _ in range(120)]
    for i in range(200):
        copy = list(hot)
        copy[r.randrange(120)] = word()
        out.append((20000 + i, " ".join(copy)))
    return out


def test_links_and_classes_equal_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, node string").repartition(5)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.classes(df).collect())
    assert got == brute(rows)


def test_blocks_of_a_large_group(spark, rows):
    import subprocess
    import sys

    # block size is fixed in the workers' module: a run with small blocks needs its own interpreter
    code = f"""
import sys; sys.path.insert(0, '.')
from collections import Counter
from pyspark.sql import SparkSession
from quillgrid.llm import ngram_join
s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 3).config('spark.ui.enabled', 'false').getOrCreate()
ngram_join.BLOCK, ngram_join.SUBTREE_BLOCK, ngram_join.PAIRS = 48, 70, 500
rows = {[x for x in rows if x[0] is not None and x[0] >= 20000]!r}
got = ngram_join.classes(s.createDataFrame(rows, 'doc_id long, text string')).collect()
print('GOT', sorted((r['doc_id'], r['class_id'], r['n_links']) for r in got))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    want = sorted(brute([x for x in rows if x[0] is not None and x[0] >= 20000]).elements())
    assert out.stdout.split("GOT ")[-1].strip() == str(want), out.stderr[-2000:]


def test_keep_one(spark, rows):
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, k1 string").repartition(4)
    kept = ngram_join.keep_one(df)
    want = {c for _, c, _ in brute(rows)}
    assert kept.columns == df.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) == len(want) and {g for g in got if g is not None} == {w for w in want if w is not None}


def test_exact_similarity_matrix():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, size=r.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    got = ngram_join._jaccard(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert abs(got[i, j] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 1e-12


def test_lengths_shorten_from_least_to_recall():
    assert ngram_join.lengths(0.8) == [6, 5, 4]
    for t in (0.5, 0.6, 0.8, 0.95):
        steps = ngram_join.lengths(t)
        assert ngram_join.meets(t, steps[0]) >= ngram_join.LEAST or steps == [1]
        assert ngram_join.meets(t, steps[-1]) >= ngram_join.RECALL and steps == sorted(steps, reverse=True)


def test_least_equal_loses_no_pair_at_the_threshold():
    r = np.random.default_rng(1)
    for t in (0.5, 0.8):
        assert (r.binomial(ngram_join.TREES * ngram_join.DEPTH, t, 200_000) < ngram_join.least_equal(t)).mean() < 1e-4


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_recall_at_other_thresholds(spark, rows, threshold):
    some = [x for x in rows if x[0] is None or x[0] < 20_030]
    got = Counter()
    for r in ngram_join.classes(spark.createDataFrame(some, "doc_id long, text string"), threshold).collect():
        got[r["doc_id"]] += r["n_links"]
    want = Counter()
    for (d, _, n), k in brute(some, threshold).items():
        want[d] += n * k
    assert all(got[d] <= want[d] for d in want) and sum(got.values()) >= 0.99 * sum(want.values())


def test_meetings_are_the_longest_shared_prefixes():
    r = np.random.default_rng(3)
    codes = r.integers(0, 3, size=(30, ngram_join.TREES, ngram_join.DEPTH)).astype(np.uint8)
    steps = [4, 3, 2]
    i, j = np.triu_indices(30, 1)
    counted = np.zeros(len(i), dtype=int)
    for tree in range(ngram_join.TREES):
        at, first = ngram_join._met(codes, steps, tree, i, j)
        counted += first
    shared = lambda d: (codes[i, :, :d] == codes[j, :, :d]).all(axis=2).any(axis=1)
    want = np.where(shared(4), 0, np.where(shared(3), 1, np.where(shared(2), 2, 3)))
    assert (at == want).all() and (counted == (want < 3)).all()


def test_shortening_ends_when_enough_is_met(spark):
    seen = lambda *rows: spark.createDataFrame(rows, "m0 long, m1 long, m2 long, w0 double, w1 double, w2 double")
    steps = [6, 5, 4]
    assert ngram_join._shortened(seen((10, 0, 0, 10.0, 10.0, 10.0), (1_000_000, 1, 0, 1_000_001.0, 1_000_001.0, 1_000_001.0)), steps) == 0
    assert ngram_join._shortened(seen((900, 100, 0, 950.0, 1000.01, 1000.0)), steps) == 1
    assert ngram_join._shortened(seen((900, 50, 50, 990.0, 999.0, 1000.0)), steps) == 2
    assert ngram_join._shortened(seen((0, 0, 0, 0.0, 0.0, 0.0)), steps) == 2 and ngram_join._shortened(seen((1, 0, 0, 1.0, 1.0, 1.0)).limit(0), steps) == 2


def test_chained_edges_connect_components_and_give_no_node_many():
    r = np.random.default_rng(5)
    linked = r.random((40, 40)) < 0.03
    linked |= linked.T
    np.fill_diagonal(linked, False)
    one, other = ngram_join._chained(linked)
    assert np.bincount(np.concatenate([one, other])).max() <= 2
    paths = np.zeros_like(linked)
    paths[one, other] = paths[other, one] = True
    reach = lambda m: np.linalg.matrix_power(m.astype(float) + np.eye(40), 40) > 0
    assert (reach(linked) == reach(paths)).all()


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(700)], "node long, to long")
    assert {r["label"] for r in ngram_join.components(edges).collect()} == {0}


def test_heads_are_the_least_of_each_path():
    r = np.random.default_rng(6)
    linked = r.random((40, 40)) < 0.03
    linked |= linked.T
    np.fill_diagonal(linked, False)
    reach = np.linalg.matrix_power(linked.astype(float) + np.eye(40), 40) > 0
    assert (ngram_join._heads(*ngram_join._chained(linked), 40) == reach.argmax(axis=1)).all()
    none = np.zeros(0, dtype=np.int64)
    assert ngram_join._heads(none, none, 3).tolist() == [0, 1, 2]


def test_a_group_of_near_copies_takes_few_rounds(spark, monkeypatch):
    """Of 600 near copies in several blocks, labels begin at their blocks' least: the rounds do not grow with the group."""
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join([*words[: i % 150], f"x{i}", *words[i % 150 :]])) for i in range(600)] + [(900, "one two three four five six"), (901, "one two three four five six")]
    counts, inside = [], []
    components, checkpointed = ngram_join.components, ngram_join.checkpointed
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df: (counts.append(1) if inside else None, checkpointed(df))[1])

    def counted(*args):
        inside.append(1)
        out = components(*args)
        inside.clear()
        return out

    monkeypatch.setattr(ngram_join, "components", counted)
    got = ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(i, 0) for i in range(600)] + [(900, 900), (901, 900)]
    assert len(counts) <= 4


def test_empty(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
