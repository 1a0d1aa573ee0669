"""Row functions: values as they come and go, and how many rows a Python worker holds at once."""

from __future__ import annotations

import itertools
import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import containers, packaging, qr, validators
from quillgrid.functions.rows import by_row
from quillgrid.plans import catalog, extras, stores  # noqa: F401 (registers its queries)

JPEG = b"\xff\xd8\xff\xda\x00\x02\xaa\xbb\xff\xd9"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_are_bytes_texts_and_nulls(spark):
    seen = by_row(lambda *v: ",".join(type(x).__name__ for x in v), T.StringType())
    df = spark.createDataFrame([(b"a", "b", 1), (None, None, None)], "x binary, y string, z long")
    assert [r[0] for r in df.select(seen("x", "y", "z")).collect()] == ["bytes,str,int", "NoneType,NoneType,NoneType"]


def test_a_worker_holds_few_rows(spark):
    """The peak of a worker's memory in MB, before and after 10,000 rows of 20 kB that go out as large as they came."""
    big = by_row(lambda t, i: (t + str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024).rjust(9)), T.StringType())
    rows = spark.range(0, 10_000, 1, 1).select(big(F.repeat(F.lit("x"), 20_000), "id").alias("t"))
    low, high = rows.select(F.substring("t", -9, 9).cast("int").alias("m")).agg(F.min("m"), F.max("m")).first()
    assert high - low < 50


@pytest.mark.parametrize("name", ["png_package_roundtrip", "jpeg_package_roundtrip", "behind_package_roundtrip"])
def test_packing_takes_rows_not_batches(spark, sf_dir, name):
    found = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "BatchEvalPython" in found and "ArrowEvalPython" not in found


def test_packed_files_come_back(spark):
    """Nulls, empty texts, a cover that is none and a name too long for a record."""
    df = spark.createDataFrame([(1, JPEG, "a\0é", "n.zip"), (2, JPEG, "", ""), (3, JPEG, None, "n"), (4, b"x", "a", "n"), (5, JPEG, "a", None), (6, JPEG, "a", "n" * 4000), (7, None, "a", "n")], "i int, cover binary, text string, name string")
    made = df.select("i", packaging.packed_file("jpeg")("cover", validators.to_zip("text"), "name").alias("c"))
    out = made.select("i", packaging.unpacked_file("c").alias("f")).select("i", validators.zip_text("f.content").alias("t"), "f.name").orderBy("i").collect()
    assert [tuple(r) for r in out] == [(1, "a\0é", "n.zip"), (2, "", ""), (3, "", "n"), *[(i, None, None) for i in (4, 5, 6, 7)]]


def test_chunk_lists_take_rows_not_batches(spark, sf_dir):
    found = plan(catalog.QUERIES["chunk_order"](spark, sf_dir))
    assert "BatchEvalPython" in found and "ArrowEvalPython" not in found


def test_chunk_lists_of_good_cut_and_missing_files(spark):
    good = containers.png_bytes("a\0é")
    df = spark.createDataFrame([(0, good), (1, good[:-1]), (2, b""), (3, None)], "i int, png binary")
    out = [r["c"] for r in df.select("i", containers.png_chunks("png").alias("c")).orderBy("i").collect()]
    assert [tuple(c) for c in out[0]] == [tuple(c.values()) for c in containers.chunk_list(good)] and out[1:] == [None] * 3


def test_symbols_take_rows_not_batches(spark, sf_dir):
    found = plan(catalog.QUERIES["qr_roundtrip"](spark, sf_dir))
    assert "BatchEvalPython" in found and "ArrowEvalPython" not in found


def test_symbols_of_texts_that_have_none(spark):
    """Null, blank and too long texts have no symbol; the longest that fits has the largest."""
    texts = ["é", "x" * qr.MOST_BYTES, "x" * (qr.MOST_BYTES + 1), " ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", qr.symbol("t").alias("s")).select("i", "s.side", F.octet_length("s.modules"), qr.symbol_text("s.side", "s.modules")).orderBy("i").collect()
    side = len(qr.encode(texts[1]))
    assert [tuple(r)[1:] for r in out] == [(29, 841, "é"), (side, side * side, texts[1]), *[(None, None, None)] * 4]


def plain_penalty(dark):
    """The standard's four marks, place by place."""
    side, total = len(dark), 0
    for lines in (dark.tolist(), dark.T.tolist()):
        for line in lines:
            runs = [len(list(g)) for _, g in itertools.groupby(line)]
            total += sum(n - 2 for n in runs if n >= 5)
            text = "".join("01"[v] for v in line)
            total += 40 * sum(text[i : i + 11] in ("10111010000", "00001011101") for i in range(side - 10))
    total += 3 * sum(len(set(dark[y : y + 2, x : x + 2].ravel().tolist())) == 1 for y in range(side - 1) for x in range(side - 1))
    return total + 10 * int(abs(dark.mean() * 100 - 50) // 5)


@pytest.mark.parametrize("text", ["a", "https://a.example/b?c=1", "é" * 60, "0" * 200])
def test_a_symbol_has_the_mask_of_least_penalty(text):
    options = [qr.encode(text, m, 0) for m in range(8)]
    marks = [plain_penalty(o) for o in options]
    assert [qr.penalty(qr.number(o), qr.number(o.T), len(o)) for o in options] == marks
    assert (qr.encode(text, margin=0) == options[marks.index(min(marks))]).all()


def test_symbols_take_little_time():
    """Of pages' length: they took 33 ms each where every line's runs were counted apart."""
    urls = [f"https://site-{i}.example/some/path/page-{i}.html" for i in range(100)]
    assert qr.packed_text(*qr.packed_symbol(urls[0])) == urls[0]
    began = time.process_time()
    assert [qr.packed_text(*qr.packed_symbol(u)) for u in urls] == urls
    assert time.process_time() - began < 1


def test_check_bytes_are_the_remainder_of_the_division():
    r = np.random.default_rng(4)
    for n in (17, 30):
        data = r.integers(0, 256, 40).tolist()
        left = [*data, *[0] * n]
        for i in range(len(data)):
            for j, d in enumerate(qr.divisor_of(n)):
                left[i + j] ^= qr.times(d, left[i]) if j else 0
        assert list(qr.check_bytes(bytes(data), n)) == left[len(data) :]


@pytest.mark.parametrize("name", ["exif_comment", "webui_parameters", "exif_orientation", "enriched_graphs"])
def test_notes_and_graphs_take_rows_not_batches(spark, sf_dir, name):
    found = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "BatchEvalPython" in found and "ArrowEvalPython" not in found
