"""Character models against plain interpolated Kneser-Ney, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgrid.llm import language, queries


def plain_model(texts, alphabet):
    """p(symbol, history) of interpolated Kneser-Ney over texts, in plain dictionaries."""
    order = language.ORDER
    counts = {order: Counter()}
    for t in texts:
        padded = " " * (order - 1) + t
        for i in range(order - 1, len(padded)):
            counts[order][padded[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in c.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        tables[k] = c, total, kinds, once / (once + 2 * twice) if once and twice else 0.5

    def p(gram):
        if not gram:
            return 1 / alphabet
        c, total, kinds, discount = tables[len(gram)]
        h = gram[:-1]
        if not total[h]:
            return p(gram[1:])
        return max(c[gram] - discount, 0) / total[h] + discount * kinds[h] / total[h] * p(gram[1:])

    return p


TEXTS = {"a": ["the cat sat on the mat", "a hat and a bat", "that cat", "the the the"], "b": ["le chat est sur le tapis", "un chapeau", "chat noir", "le le"]}


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(100 * i + j, t, name) for i, (name, ts) in enumerate(TEXTS.items()) for j, t in enumerate(ts * 3)] + [(999, "no label", None)], "doc_id long, text string, lang string")
    return docs, language.learn(docs, "lang").value


def test_probabilities_are_plain_kneser_ney(spark):
    number = np.zeros(0x110000, dtype=np.uint16)
    for i, c in enumerate(sorted({c for ts in TEXTS.values() for t in ts for c in t})):
        number[ord(c)] = i + 1
    docs = spark.createDataFrame([(i, t) for i, ts in enumerate(TEXTS.values()) for t in ts], "language int, text string")
    counted = language._counts(docs, number, language.CELLS)
    single, grams, contexts = language.kneser_ney(*counted, len(TEXTS))
    model = language.Model(list(TEXTS), number, single, grams, contexts, np.zeros(3))
    plain = [plain_model(ts, language.ALPHABET) for ts in TEXTS.values()]
    r = random.Random(2)
    asked = ["the mat", "le chapeau noir", "cat", "zebra", "", *["".join(r.choices("theca lsno", k=30)) for _ in range(20)]]
    sizes, total = model.sums(asked)
    for i, t in enumerate(asked):
        padded = " " * 4 + t
        for j, p in enumerate(plain):
            # 'z' and 'b' that a language lacks are symbols like others
            want = sum(math.log(p(padded[k - 4 : k + 1])) for k in range(4, len(padded)))
            assert total[i, j] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert sizes.tolist() == [len(t) for t in asked]


def test_probabilities_add_up_to_one(small):
    _, model = small
    for history in ("    ", " the", "zzzz", "le c"):
        keys = language.grams(model.number, [history + chr(c) for c in range(32, 0x2000) if model.number[c]])
        last = keys[len(history) :: len(history) + 1]
        symbols = np.unique(model.number)
        base = (last[0] >> language.BITS) << language.BITS
        every = base | np.arange(language.ALPHABET, dtype=np.int64)
        assert len(symbols) > 10
        assert np.exp(model.log_probabilities(every).astype(float)).sum(axis=0) == pytest.approx([1, 1], rel=1e-4)


def test_hashed_rows_are_found():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 60, 5000))
    table = language.Hashed(keys, np.arange(len(keys)))
    asked = np.concatenate([keys, r.integers(0, 1 << 60, 5000), [0]])
    at, found = table.find(asked)
    assert (found == np.isin(asked, keys)).all()
    assert (table.rows[at[found]] == np.searchsorted(keys, asked[found])).all()
    assert not language.Hashed(keys[:0], np.zeros((0, 2))).find(asked)[1].any()


def test_fewer_cells_drop_the_rarest(spark):
    docs = spark.createDataFrame([(0, "abcdef " * 50 + "xyz")], "language int, text string")
    number = language._alphabet(docs)
    every = language._counts(docs, number, language.CELLS)[2]
    some = language._counts(docs, number, 20)[2]
    assert every.min() == 1 < some.min() and len(some) <= 10


def test_odd_rows(spark, small):
    docs, _ = small
    rows = [(1, None), (2, ""), (3, "12 + 34!"), (4, "le chat noir"), (4, "le chat noir"), (5, "THE CAT, the hat"), (None, "the mat"), (6, "漢字"), (7, "le chat " * 40_000)]
    odd = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang_pred string")
    model = language.learn(docs, "lang")
    got = {(r["doc_id"], r["letters"]): r for r in language.predict(odd, ["doc_id"], model).collect()}
    assert {k: (r["lang_pred"], 0 <= r["score"] <= 1) for k, r in got.items()} == {(1, 0): ("und", True), (2, 0): ("und", True), (3, 0): ("und", True), (4, 12): ("b", True), (5, 15): ("a", True), (None, 7): ("a", True), (6, 2): (got[6, 2]["lang_pred"], True), (7, 319_999): ("b", True)}
    assert all(r["score"] == 0 and r["rejected"] and r["cross_entropy"] is None for r in got.values() if r["lang_pred"] == "und")
    assert got[7, 319_999]["score"] > 0.5
    assert language.predict(odd.limit(0), ["doc_id"], model).collect() == []
    nothing = language.learn(docs.where("false"), "lang")
    assert {r["lang_pred"] for r in language.predict(odd, ["doc_id"], nothing).collect()} == {"und"}
    one = language.learn(docs.where("lang = 'a'"), "lang")
    assert {r["lang_pred"] for r in language.predict(odd, ["doc_id"], one).collect()} == {"und", "a"}


def test_held_out_documents(spark):
    got = queries.op12_kneser_ney_languages(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))
    asked = [r for r in got if r["held_out"] and r["lang_pred"] != "und" and docs[r["doc_id"]]["lang"] is not None]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in asked]
    assert len(asked) > 200 and sum(right) > 0.985 * len(right)
    # how sure it is tells how often it is right, and what is not rejected is almost always right
    assert abs(np.mean([r["score"] for r in asked]) - np.mean(right)) < 0.02
    kept = [x for r, x in zip(asked, right) if not r["rejected"]]
    assert len(kept) > 0.95 * len(asked) and np.mean(kept) > 0.99
