import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import pii

#: The contract's patterns, applied plainly.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    bits = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "255", "0256", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "5105105105105100", "-", " ", "x", "é", "😀", "12", "(555) 123-4567", "joe [at] mail [dot] com", "+49", "\n", "%"]
    return ["".join(r.choices(bits, k=r.randint(1, 14))) for _ in range(1500)] + [None, "", "7" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "1." * 20_000, "a@b.c " * 2000]


def test_strict_spans_equal_the_plain_patterns(spark, texts):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.find_spans(df, ["doc_id"]).collect():
        t = texts[r["doc_id"]]
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]] == plain(t), t
        assert all(t[s["start"] : s["end"]] for s in r["spans"])


def test_model_adds_loose_spans_and_leaves_prose_alone(spark):
    rows = [(i, f"please write to person{i}@mail.example.com or phone +1 (212) 555-{1000 + i} today") for i in range(60)]
    rows += [(100, "my e-mail: jane [at] mail [dot] com , phone: (212) 555-0199 ok"), (101, "plain prose, version 1.2, in 1999 and 2000-2001, is left alone"), (102, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [pii.KINDS[s["kind"]] for s in got[100]] == ["email", "phone"] and got[101] == [] and got[102] == []


def test_reliabilities():
    good = {"kind": 0, "strict": True, "n": 90, **dict.fromkeys(pii.VOTES, 1)}
    bad = {"kind": 0, "strict": False, "n": 90, **dict.fromkeys(pii.VOTES, -1)}
    noise = [{"kind": 0, "strict": True, "n": 10, **dict.fromkeys(pii.VOTES, 1), "context": -1}, {"kind": 0, "strict": False, "n": 10, **dict.fromkeys(pii.VOTES, -1), "context": 1}]
    # for another kind the labelers may be wrong in other ways
    other = [{**p, "kind": 3, "n": 50} for p in (good, bad)] + [{**good, "kind": 3, "grouping": -1, "n": 45}, {**bad, "kind": 3, "grouping": 1, "n": 45}]
    odds, post = pii.estimate([good, bad, *noise, *other])
    assert post[0] > 0.99 and post[1] < 0.01 and post[2] > 0.9 and post[3] < 0.1
    assert odds[0]["format"][1] > odds[0]["context"][1] > 0 and odds[0]["grouping"][1] > odds[3]["grouping"][1] + 1 and abs(odds[3]["grouping"][1]) < 0.5
    weights = pii.train([{**p, **dict.fromkeys(pii.FEATURES, 0)} for p in (good, bad)], [0.99, 0.01])
    assert weights["format:1"] > 0 > weights["format:-1"] and weights["0:format:1"] > 0 == weights["1:format:1"]


def test_labelled_set_of_loose_spans(spark):
    """Precision and recall on texts whose loose spans are known."""
    r = random.Random(21)
    d = lambda n: "".join(r.choices("123456789", k=n))
    rows, want = [], {}
    for i in range(240):
        rows.append((i, f"mail p{i}@mail.example.com, phone +1 (212) 555-{1000 + i}, host 81.2.69.{i % 250}, card 4111 1111 1111 1111 now"))
    made = {
        "email": lambda: f"joe{d(2)} [at] mail [dot] com", "phone": lambda: f"({r.randrange(212, 890)}) 555-{d(4)}",
        "ip": lambda: f"81[.]2[.]69[.]{r.randrange(1, 250)}", "card": lambda: f"4{d(3)}.{d(4)}.{d(4)}.{d(4)}",
    }
    cues = {"email": "write e-mail: ", "phone": "call phone: ", "ip": "server ip: ", "card": "credit card: "}
    decoys = [lambda: f"section 1.{d(1)} of {d(4)}.{d(4)}", lambda: f"order no. {d(9)}", lambda: "version 1.2.3", lambda: f"figure {d(2)}/{d(2)}"]
    for i in range(1000, 1200):
        kind = r.choice(list(made))
        span, decoy = made[kind](), r.choice(decoys)()
        text = f"so {cues[kind]}{span} , then {decoy} end"
        rows.append((i, text))
        want[i] = (text.index(span), pii.KINDS.index(kind), text.index(span) + len(span))
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).where("doc_id >= 1000").collect()
    added = {(x["doc_id"], (s["start"], s["kind"], s["end"])) for x in got for s in x["spans"] if not s["base"]}
    right = added & set(want.items())
    assert len(right) >= 0.95 * len(added) and len(right) >= 0.7 * len(want)


def test_redaction_is_plain_and_linear(spark, texts):
    import time

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, "a@b.c 1.2.3.4 " * 8000)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(df, ["doc_id"]).collect()}
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in pii.redact_documents(df).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        want, pos = [], 0
        for s in spans[i]:
            if s["start"] >= pos:
                want += [t[pos : s["start"]], f"<{pii.KINDS[s['kind']].upper()}>"]
            pos = max(pos, s["end"])
        assert out[i] == (None if t is None else "".join(want) + t[pos:])
    assert out[9999] == "<EMAIL> <IP> " * 8000


def test_query_columns_come_from_the_operator(spark, tmp_path, texts):
    from quillgrid.llm import queries

    spark.createDataFrame(list(enumerate(texts[:200] + [None])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_personal_data(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in pii.KINDS}, "base_sha256": "string", "spans": "string"}
    for row in out.collect():
        base = plain((texts[:200] + [None])[row["doc_id"]])
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]


def test_redaction(spark, docs):
    out = {r["doc_id"]: r for r in pii.redact_documents(docs).where("doc_id between 6 and 7").collect()}
    assert out[6]["text"].startswith("mail <EMAIL> or b@<EMAIL> now, ip <IP>") and "example.com" not in out[6]["text"]
    assert "4111" not in out[7]["text"] and "555" not in out[7]["text"] and out[7]["n_chars"] == len(out[7]["text"])
    kept = pii.redact_documents(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.where(F.col("doc_id") == 100).first()["text"] == docs.where(F.col("doc_id") == 100).first()["text"]


def test_empty(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def plain_em(patterns, rounds=60):
    """Posteriors of vote patterns by expectation-maximisation in probabilities, row by row."""
    post = {}
    for kind in {p["kind"] for p in patterns}:
        rows = [(i, tuple(p[v] for v in pii.VOTES)) for i, p in enumerate(patterns) if p["kind"] == kind for _ in range(p["n"])]
        mine = {i: 1 / (1 + math.exp(-sum(votes))) for i, votes in rows}
        for _ in range(rounds):
            yes, no = 1 + sum(mine[i] for i, _ in rows), 1 + sum(1 - mine[i] for i, _ in rows)
            given = {(v, k): ((1 + sum(mine[i] for i, x in rows if x[v] == k)) / (yes + 2), (1 + sum(1 - mine[i] for i, x in rows if x[v] == k)) / (no + 2)) for v in range(len(pii.VOTES)) for k in (-1, 0, 1)}
            for i, x in dict(rows).items():
                a, b = yes, no
                for v, k in enumerate(x):
                    a, b = a * given[v, k][0], b * given[v, k][1]
                mine[i] = min(1 / (1 + math.exp(-30.0)), max(1 / (1 + math.exp(30.0)), a / (a + b)))
        post |= mine
    return [post[i] for i in range(len(patterns))]


def plain_classifier(patterns, post, rounds=400):
    """Logistic regression by plain gradient steps over dictionaries."""
    seen = [["bias", f"kind:{p['kind']}", *(["loose"] if not p["strict"] else []), *[f"{v}:{p[v]}" for v in pii.VOTES if p[v]], *[f"{p['kind']}:{v}:{p[v]}" for v in pii.VOTES if p[v]], *[f for f in pii.FEATURES if p[f]]] for p in patterns]
    total, w = sum(p["n"] for p in patterns), {}
    for _ in range(rounds):
        slope = {}
        for p, y, names in zip(patterns, post, seen):
            miss = p["n"] / total * (y - 1 / (1 + math.exp(-max(-30, min(30, sum(w.get(f, 0.0) for f in names))))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + miss
        for f in slope:
            w[f] = w.get(f, 0.0) + 0.5 * (slope[f] - 1e-3 * w.get(f, 0.0))
    return w, seen


def test_spans_are_those_of_plain_em_and_classifier(spark):
    """Labelers' votes taken from Spark, all after them in plain Python: the same posteriors, weights and added spans."""
    texts = ["write to ann [at] mail [dot] example [dot] org now", "mail bob@mail.example.com or eve@x.example.org", "call 212-555-0187 today", "tel 020 7946 0958", "host 10[.]20[.]30[.]40 and 8.8.8.8 here", "server 192[.]0[.]2[.]17"]
    texts += ["card 4111.1111.1111.1111 charged", "card 4111 1111 1111 1111", "order 555-123-4567 shipped", "§ 123.456.7890", "version 1.2.3.4 and phone +44 20 7946 0958", "00 49 30 123456", "fax 0049 30 1234 5678", "joe (at) corp (dot) net", "v 4[.]5[.]6[.]7"]
    r = random.Random(2)
    docs = spark.createDataFrame([(i, r.choice(texts) + " and " + r.choice(texts)) for i in range(300)], "doc_id long, text string")
    found = docs.select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("x")).select("doc_id", "x.*").collect()
    names = ("kind", "strict", *pii.VOTES, *pii.FEATURES)
    counts = Counter(tuple(x[n] for n in names) for x in found)
    patterns = [dict(zip(names, k)) | {"n": n} for k, n in sorted(counts.items())]
    post = pii.estimate(patterns)[1]
    assert post == pytest.approx(plain_em(patterns), abs=1e-6)
    weights, seen = plain_classifier(patterns, post)
    mine = pii.train(patterns, post)
    assert all(mine[f] == pytest.approx(w, abs=1e-6) for f, w in weights.items())
    score = {tuple(p[n] for n in names): 1 / (1 + math.exp(-sum(weights[f] for f in fs))) for p, fs in zip(patterns, seen)}
    want = {}
    for x in found:
        if x["base"] or (not x["strict"] and score[tuple(x[n] for n in names)] >= pii.ADD_AT):
            want.setdefault(x["doc_id"], []).append(x)
    want = {i: sorted((x["start"], x["kind"], x["end"]) for x in xs if x["base"] or not any(y["base"] and y["start"] < x["end"] and x["start"] < y["end"] for y in xs)) for i, xs in want.items()}
    got = {g["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in g["spans"]] for g in pii.find_spans(docs, ["doc_id"]).collect()}
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in want.items() if s}
    added = sum(not s["base"] for g in pii.find_spans(docs, ["doc_id"]).collect() for s in g["spans"])
    assert added > 50
