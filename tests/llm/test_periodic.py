"""Periodic runs against a plain search by all periods, and the query's digests over the smallest tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.llm import periodic, queries


def plain_runs(words):
    """(start, length, period) of all runs, by start and period: each period's stretches, without those of a smaller one."""
    out = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            x = words[start : i + q]
            if len(x) >= max(6, 4 * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.add((start, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 9)), max_size=5))
def test_runs_are_those_of_a_plain_search(parts):
    documents = [w * n + w[: len(w) // 2] for w, n in parts]
    start, length, period = periodic.runs(np.array([x for d in documents for x in d], dtype=np.int64), np.array([len(d) for d in documents], dtype=np.int64))
    want, at = [], 0
    for d in documents:
        want += [(at + s, n, q) for s, n, q in plain_runs(d)]
        at += len(d)
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_one_word_many_times_is_one_run():
    start, length, period = periodic.runs(np.zeros(50_000, dtype=np.int64), np.array([50_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [50_000], [1])


def test_names_tell_equal_windows():
    base = np.array([random.Random(5).randrange(2) for _ in range(300)])
    for k, level in enumerate(periodic.named(base)):
        windows = [tuple(base[i : i + (1 << k)]) for i in range(len(base) - (1 << k) + 1)]
        for i, a in enumerate(windows):
            for j in range(i):
                assert (level[i] == level[j]) == (a == windows[j])


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a " * 6), (2, "a " * 6), (3, "a b " * 4 + "c"), (4, " \t\n "), (5, "a a a a a"), (6, "x y z " * 70_000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words long")
    found = periodic.find_runs(docs, ["doc_id"], periodic.words(F.col("text"))).collect()
    told = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found))
    six = (2, 6, [(0, 6, 1)], "a")
    assert told == [(0, 0, [], ""), (1, 0, [], ""), six, six, (3, 9, [(0, 8, 2)], "a b c"), (4, 0, [], ""), (5, 5, [], "a a a a a"), (6, 210_000, [(0, 210_000, 3)], "x y z")]
    null_word = spark.sql("SELECT 1L AS doc_id, array(null, null, null, '', '', '', 'a') AS w")
    assert [tuple(x) for x in periodic.find_runs(null_word, ["doc_id"], F.col("w")).first()["runs"]] == [(0, 6, 1)]
    assert periodic.find_runs(docs.limit(0), ["doc_id"], periodic.words(F.col("text"))).collect() == []


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def expected(doc_id, text):
    words = (text or "").encode("utf-8").split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(plain_kept(words, runs)).decode()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


@pytest.fixture(scope="module")
def short(spark, sf_dir, tmp_path_factory):
    """The shorter texts of the smallest table, with odd ones."""
    folder = str(tmp_path_factory.mktemp("short"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000").select("doc_id", "text")
    odd = spark.createDataFrame([(9001 + i, t) for i, t in enumerate([None, "", "a", "b " * 40, "one two three " * 30] + [f"w{j} x y z" * 9 for j in range(60)])], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_is_the_plain_search(spark, short):
    got = {r["doc_id"]: tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.op13_periodic_runs(spark, short).collect()}
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{short}/documents.parquet").collect()}
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 10
