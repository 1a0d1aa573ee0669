import re

from quillgrid.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    rep = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), n < 20 or 100 * len(rep) > 30 * n


def test_counts(docs, doc_rows):
    got = quality.assess(docs, ["doc_id"]).collect()
    want = sorted(((i, *plain(t)) for i, t in doc_rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=str) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_bands():
    import base64
    import random

    prose = " ".join(random.Random(1).choices([a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrst"], k=900))
    assert quality.assess_text(prose)[-1]
    assert not quality.assess_text(base64.b85encode(random.Random(2).randbytes(6000)).decode().replace("a", " "))[-1]
    menu = [f"page {i} of the very same list of things to do and to see" for i in range(400)]
    assert not quality.assess_text("\n".join(menu))[-1]


def test_chunks_and_verdict_are_plain():
    import base64
    import random

    import zstandard

    r = random.Random(5)
    prose = lambda k: " ".join(r.choices([a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnrst"], k=k))
    junk = lambda n: " ".join(base64.b85encode(r.randbytes(20)).decode() for _ in range(n))
    clean = [prose(k) for k in (30, 300, 1030, 1300, 2100, 5000, 15000)]
    mixed = [prose(5000) + " " + junk(700), prose(9000) + " " + junk(900), prose(1000) + " " + junk(80)]
    for text in clean + mixed + ["x" * 4096 + "y" * 1023, "", None]:
        raw = (text or "").encode()
        size = lambda x: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(x))
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        if len(chunks) > 1 and len(chunks[-1]) < 1024:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        chunks = chunks if len(chunks) > 1 else []
        bad = sum(not quality.band(quality.CHUNK_BANDS, len(c), len(c) / size(c)) for c in chunks)
        got = quality.assess_text(text)
        assert got[-3:-1] == (bad, len(chunks))
        share = 0.5 if len(chunks) < 5 else 0.25 if len(chunks) < 17 else 0.15
        whole = quality.band(quality.WHOLE_BANDS, len(raw), len(raw) / size(raw) if raw else 0.0)
        assert got[-1] == (not got[5] and whole and bad <= share * len(chunks))
    assert all(quality.assess_text(t)[-1] for t in clean) and not any(quality.assess_text(t)[-1] for t in mixed[:2])


def test_stage_keeps_columns(docs):
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_empty(spark):
    assert quality.assess(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_bands_lie_outside_of_what_clean_texts_measure(spark):
    """The record of how the limits are found: a thousandth of the labelled clean texts, and of their chunks, may lie beyond."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    clean = docs.join(labels.where("quality = 1 and toxic = 0").select("doc_id").distinct(), "doc_id")
    base = quality.assess(clean, ["doc_id"]).where("not base_failed").select("doc_id")
    found = quality.measured_bands(clean.join(base, "doc_id")).collect()
    assert {r["top"] for r in found if not r["chunks"]} >= {256.0, 512.0, 1024.0, 2048.0, 4096.0, 8192.0, 32768.0}
    limits = {(chunks, float(top)): (low, high) for chunks, bands in ((False, quality.WHOLE_BANDS), (True, quality.CHUNK_BANDS)) for top, low, high in bands}
    for r in found:
        low, high = limits[r["chunks"], r["top"]]
        if r["texts"] >= 100:  # below that there is no such quantile
            assert low <= r["low"] and r["high"] <= high, r
    assert quality.measured_bands(clean.limit(0)).collect() == []
