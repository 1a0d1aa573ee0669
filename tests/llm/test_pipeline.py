import random
from pathlib import Path
from urllib.parse import urlparse

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillgrid.llm import pii, quality


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] == kept[3] > 0
    packed = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_odd_rows_go_through(spark, sf_dir, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with clashing names, and nothing at all."""
    r = random.Random(7)
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumn("length", F.lit("clash"))
    odd = docs.union(docs).union(some).union(some).union(some.limit(1).withColumn("text", F.lit(" ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(60_000)))))
    odd = odd.withColumn("row", F.lit("clash")).withColumn("tokens", F.lit(None).cast("string"))
    for name, rows in (("some", odd), ("none", odd.limit(0))):
        at = rows
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, at, sf_dir).write.parquet(str(tmp_path / name / str(i)))
            before, at = at, spark.read.parquet(str(tmp_path / name / str(i)))
            if i < 4:
                assert at.columns == odd.columns
        assert (at.count() > 0) == (name == "some")
        assert before.where("doc_id is not null").groupBy("text").count().where("count > 5").count() == 0  # one row of a class, mixed at most MOST times


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.count() > 0
    folder = Path(urlparse(out.inputFiles()[0]).path).parent
    assert [x.name for x in folder.parent.iterdir()] == ["4"]  # the other stages' tables are gone
    assert [n for n, _ in cp.STAGES] == ["quality rules", "n-gram Jaccard join", "personal data", "mixing", "best-fit packing"]


def test_first_three_stages_are_plain(spark, sf_dir):
    """Which rows the quality rules keep, which one of each class of near duplicates stays, and what personal data becomes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = cp.STAGES[0][1](spark, docs, sf_dir)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert rows == {r["doc_id"]: r["text"] for r in docs.collect() if quality.assess_text(r["text"])[-1]}
    sets = {}
    for i, text in rows.items():
        words = text.split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    ids, head = sorted(rows), {i: i for i in rows}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    single = cp.STAGES[1][1](spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i in ids if root(i) == i) != ids
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(single, ["doc_id"]).collect()}
    for r in cp.STAGES[2][1](spark, single, sf_dir).collect():
        text, at, out = rows[r["doc_id"]], 0, []
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{pii.KINDS[s['kind']].upper()}>"]
            at = max(at, s["end"])
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])
    assert any(spans.values())
