import math

import numpy as np

from quillgrid.llm import ann


def brute(rows, k=10, every=100):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, qv in ok:
        if q % every == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(qv)) ** 2).sum())), i) for i, v in ok if i != q)
            out[q] = d[:k]
    return out


def make(n=1200, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16)]) for i in range(n)]
    same = rows[7][1]
    rows += [(2000 + i, same) for i in range(400)]
    return rows + [(None, same), (5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] + [0.0] * 14), (5400, [1.0] * 3), (5500, [float("inf")] * 16), rows[3]]


def test_recall_ties_and_cases(spark):
    rows = make()
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(6)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, near in want.items():
        mine = [(s, i) for _, s, i in sorted(got[q])]
        assert [x[0] for x in sorted(got[q])] == list(range(1, 11))
        hits += len({i for _, i in mine} & {i for _, i in near})
        total += 10
        if q >= 2000:
            assert [i for _, i in mine] == [i for _, i in near]  # all at distance 0: the smallest ids
    assert hits / total >= 0.9


def test_exact_with_all_probes(spark):
    rows = make(150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, probes=4096).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q, near in brute(rows).items():
        assert [i for _, i in sorted(got[q])] == [i for _, i in near]
        assert np.allclose([s for s, _ in sorted(got[q])], [s for s, _ in near], rtol=1e-12)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few).collect()] == [(0, 1, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_of_one_id_are_one_point(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in [*range(40), *range(0, 40, 3), 0, 0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, every=10, probes=10_000).collect():
        got.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
    for q in (0, 10, 20, 30):
        near = {}
        for a in (np.array(v) for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    near[i] = min(near.get(i, np.inf), float(np.sqrt(((np.array(v) - a) ** 2).sum())))
        assert [i for _, i in sorted(got[q])] == [i for _, i in sorted((d, i) for i, d in near.items())[:10]]


def test_best_buckets_are_brute_force():
    r = np.random.default_rng(6)
    for n, most in ((1, 3), (2, 17), (3, 40), (3, 10_000)):
        scores = [r.normal(size=8) for _ in range(n)]
        every = np.array([sum(s[i] for s, i in zip(scores, np.unravel_index(c, [8] * n))) for c in range(8**n)])
        assert ann.best_buckets(scores, most).tolist() == np.argsort(-every, kind="stable")[:most].tolist()


def share(n, k=10):
    """Recall and the share of all rows a query is compared with, by the module's own choices."""
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(n // 10, 32)), 10, axis=0) + 0.35 * r.normal(size=(n, 32))
    hashed, _ = ann.polytopes(n, 64)
    signs, asks = ann.rotations(32, ann.TABLES, hashed), r.choice(n, 40, replace=False)
    seen = np.zeros((40, n), dtype=bool)
    for table in signs:
        own, scores = ann._codes(x, table), [ann.axes(x[asks], s) for s in table]
        for i in range(40):
            seen[i] |= np.isin(own, ann.best_buckets([s[i] for s in scores], 12))
    near = [np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1 : k + 1] for q in asks]
    return np.mean([seen[i][near[i]].mean() for i in range(40)]), seen.mean()


def test_candidates_fall_as_rows_grow():
    few, many = share(4000), share(32_000)
    assert many[1] < 0.5 * few[1] and many[1] < 0.1


def test_polytopes_follow_the_rows():
    assert [ann.polytopes(n, 128) for n in (10, 2000, 50_000, 10**6, 10**9)] == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 3)]


def test_hadamard_is_the_matrix():
    r = np.random.default_rng(0)
    for n in (1, 2, 8, 64, 128):
        h = np.array([[(-1) ** bin(i & j).count("1") for j in range(n)] for i in range(n)]) / np.sqrt(n)
        x = r.normal(size=(3, n))
        assert np.allclose(ann.hadamard(x), x @ h)


def test_too_few_probes_are_said(spark, monkeypatch, caplog):
    """Where the most probes find less than wanted, the fit says so and takes them."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    monkeypatch.setattr(ann, "MOST_PROBES", 2)
    signs = ann.rotations(16, tables=1, polytopes=2)
    assert ann.fit_probes(rows, rows.where("vec_id % 100 = 0"), signs, 10) == 2
    assert "2 probes a table find" in caplog.text
