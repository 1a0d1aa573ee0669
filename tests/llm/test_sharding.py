import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillgrid.llm import sharding


def check(rows, got, shards=8):
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    n = Counter(r["shard"] for r in got)
    counts = [n.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["law"] for r in got} <= {"rows"} and all(r["grown_shard"] is None for r in got)


def test_law(docs, doc_rows):
    check(doc_rows, sharding.shard_documents(docs).collect())


def test_links_come_together(spark):
    r = random.Random(4)
    rows = [(i, f"unique {i}") for i in range(1500)] + [(2000 + i, f"pair {i // 2}") for i in range(400)] + [(3000 + i, f"group {i // 12}") for i in range(360)] + [(5000 + i, "hot") for i in range(1100)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = sharding.cut_links(sharding.propagate(df, rounds=0)).first()
    placed = sharding.propagate(df)
    after = sharding.cut_links(placed).first()
    assert after["cut"] < 0.15 * before["cut"]
    check(rows, sharding.shard_documents(df).collect())
    assert placed.where("linked > 1").agg(F.max("linked")).first()[0] < 100  # the hot group is cut into parts


def test_quotas_keep_sizes():
    r = random.Random(8)
    for _ in range(200):
        n = 4
        asked = {(s, t): r.randrange(20) for s in range(n) for t in range(n) if s != t}
        single = [r.randrange(15) for _ in range(n)]
        move, fill = sharding.quotas(asked, single)
        for s in range(n):
            assert sum(move[s]) + sum(fill[s]) == sum(move[t][s] + fill[t][s] for t in range(n))
            assert sum(fill[s]) <= single[s] and all(0 <= move[s][t] <= asked.get((s, t), 0) for t in range(n))


def test_few_and_none(spark):
    check([(1, "a"), (2, "a")], sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).collect())
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_of_large_texts_are_plain():
    """A large text goes where most of it is, if it fits there whole; the places left add up."""
    r = random.Random(3)
    for _ in range(50):
        held = {t: [r.randrange(5) for _ in range(4)] for t in range(12)}
        sizes = [sum(h[s] for h in held.values()) + 6 for s in range(4)]
        goes, free = sharding.places(held, sizes)
        assert all(sum(goes[t]) == sum(held[t]) for t in held)
        assert [sizes[s] - sum(g[s] for g in goes.values()) for s in range(4)] == free and min(free) >= 0
        # a text that fits whole where most of it is, with all larger ones placed, is there
        left = list(sizes)
        for t in sorted(held, key=lambda t: (-sum(held[t]), t)):
            n, fits = sum(held[t]), [s for s in range(4) if left[s] >= sum(held[t])]
            if fits and n:
                best = max(fits, key=lambda s: (held[t][s], left[s], s))
                assert goes[t][best] == n
            left = [a - b for a, b in zip(left, goes[t])]


def test_query_columns_come_from_the_operator(spark, sf_dir):
    from quillgrid.llm import queries

    out = queries.op9_label_propagation_shards(spark, sf_dir)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, out.collect())


def test_very_long_texts(spark):
    rows = [(i, "x" * 400_000) for i in range(3)] + [(i, str(i)) for i in range(3, 30)]
    check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_a_round_is_a_plain_propagation(spark):
    """One round against plain Python from the same start: every text of several rows asks for the shard that most of it is in, and
    of those that ask, and of single rows, as many move as the quotas say, and no others."""
    r = random.Random(9)
    texts = [f"text {i}" for i in range(330) for _ in range(r.choice([1, 1, 2, 3, 5]))]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    n = 4
    assert max(map(texts.count, texts)) <= len(texts) // (n * sharding.PARTS)  # none is large
    before = {x["doc_id"]: x for x in sharding.propagate(docs, n, 0).collect()}
    after = {x["doc_id"]: x["shard"] for x in sharding.propagate(docs, n, 1).collect()}
    named = {x["u"]: x["s"] for x in spark.createDataFrame([(u,) for u in {x["unit"] for x in before.values()}], "u long").selectExpr("u", f"pmod(xxhash64(u), {n}) AS s").collect()}
    held, wants = {}, {}
    for x in before.values():
        if x["copies"] > 1:
            held.setdefault(x["unit"], [0] * n)[x["shard"]] += 1
    for unit, by in held.items():
        wants[unit] = max(range(n), key=lambda s: (by[s], s == named[unit], s))  # noqa: B023
    asked, single = {}, [0] * n
    for x in before.values():
        if x["copies"] == 1:
            single[x["shard"]] += 1
        elif wants[x["unit"]] != x["shard"]:
            k = x["shard"], wants[x["unit"]]
            asked[k] = asked.get(k, 0) + 1
    move, fill = sharding.quotas(asked, single)
    moved, filled = [[0] * n for _ in range(n)], [[0] * n for _ in range(n)]
    for i, x in before.items():
        if after[i] != x["shard"]:
            if x["copies"] == 1:
                filled[x["shard"]][after[i]] += 1
            else:
                assert after[i] == wants[x["unit"]]
                moved[x["shard"]][after[i]] += 1
    assert (moved, filled) == (move, fill) and sum(map(sum, move)) > 50
    sizes = [list(after.values()).count(s) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
