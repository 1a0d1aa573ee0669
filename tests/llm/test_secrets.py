import hashlib
import random
import re

from quillgrid.llm import secrets

ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def plain(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_strict_spans_equal_the_plain_patterns(spark):
    r = random.Random(5)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", '"', "'", " ", ":", "=", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789ab", "é", "\n", "tokKen", "ſecret"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 14))) for _ in range(3000)] + [None, "", "a" * 50_000, "token" * 5000 + " " * 5000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, links string")
    for row in secrets.find_secrets(df, ["doc_id"]).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in row["spans"] if s["kind"] < 3] == plain(texts[row["doc_id"]])


KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1234"


def test_weak_parts_need_company():
    assert secrets.scan(f"only {KEY} stands here")[0] == []
    assert secrets.scan("login: joe_user at https://db.example.com")[0] == []
    spans, links = secrets.scan(f"login: joe_user key {KEY} at https://db.example.com/x")
    assert [s[0] for s in spans] == [3, 4, 5] and len(links) == 1
    mail, key = "joe.x@mail.example.org", 'token = "abcdef123456"'
    text = f"{mail} said {key} on 10.1.2.3:8080 and version 1.2.3.4.5"
    assert [(secrets.KINDS[k], text[a:b]) for k, a, b in secrets.scan(text)[0]] == [("identifier", mail), ("assign", key[:-1]), ("endpoint", "10.1.2.3:8080")]
    assert secrets.scan(f"{mail} and 10.1.2.3")[0] == []
    assert secrets.scan("user: " + "n" * 500 + f" {KEY}")[0][0][1:] == (6, 506)
    far = secrets.scan(f"login: joe_user {'. ' * 400} key {KEY}")[0]
    assert far == []


def test_nearest_is_brute_force():
    r = random.Random(9)
    for _ in range(300):
        parts = sorted({(a := r.randrange(1000), a + 3) for _ in range(r.randint(0, 8))})
        span = (b := r.randrange(1000), b + 5)
        got = secrets._nearest(parts, [p[0] for p in parts], span, 100)
        gaps = [max(0, p[0] - span[1]) if p[0] >= span[0] else max(0, span[0] - p[1]) for p in parts]
        assert (got is None) == (min(gaps, default=101) > 100)
        if got:
            assert gaps[parts.index(got)] == min(gaps)


def test_empty(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_query_columns_come_from_the_operator(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillgrid.llm import queries

    texts = [f"login: joe_user key {KEY} at https://db.example.com", "password=abcdef1", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_credential_linking(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string", "links": "string"}
    rows = {r["doc_id"]: r for r in out.collect()}
    key = texts[0].index(KEY)
    assert rows[0]["links"] == f"7:15/{key}:{key + len(KEY)}/{texts[0].index('https')}:{len(texts[0])}" and rows[0]["n_assign"] == 0
    for i, t in enumerate(texts):
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain(t))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert rows[1]["spans"] == "assign:0:16" and rows[2]["spans"] == rows[3]["spans"] == ""
