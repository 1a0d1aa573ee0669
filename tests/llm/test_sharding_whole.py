import random
from collections import Counter, defaultdict

import pytest
from test_sharding import check

from quillgrid.llm import sharding


def placed_by_text(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, sharding.shard_documents(df).collect())
    placed = sharding.propagate(df)
    texts, by = dict(rows), defaultdict(Counter)
    for r in placed.collect():
        by[texts[r["doc_id"]]][r["shard"]] += 1
    return by, sharding.cut_links(placed).first()


def shuffled(groups):
    rows = [f"{name} {i}" for name, n, size in groups for i in range(n) for _ in range(size)]
    random.Random(7).shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("groups", [[("single", 182, 1), ("pair", 9, 2), ("triple", 1, 3)], [("single", 1000, 1), ("pair", 100, 2), ("hundredth", 3, 16), ("twentieth", 4, 80)]])
def test_groups_that_fit_a_shard_stay_whole(spark, groups):
    by, cut = placed_by_text(spark, shuffled(groups))
    assert all(len(x) == 1 for x in by.values())
    assert (cut["cut"], cut["cut_pairs"]) == (0, 0)


def test_larger_groups_take_the_fewest_shards(spark):
    by, cut = placed_by_text(spark, shuffled([("single", 800, 1), ("pair", 50, 2), ("half", 1, 700)]))
    assert len(by["half 0"]) == 4 and sum(len(x) > 1 for x in by.values()) == 1
    held = by["half 0"].values()
    assert cut["cut"] == 0 and cut["cut_pairs"] == (700**2 - sum(n * n for n in held)) // 2


def test_places():
    r = random.Random(3)
    for _ in range(300):
        sizes = [r.randrange(1, 40) for _ in range(5)]
        held, room = {}, sum(sizes)
        for t in range(r.randrange(8)):
            by = [r.randrange(6) for _ in sizes]
            if 0 < sum(by) <= room:
                held[t], room = by, room - sum(by)
        goes, free = sharding.places(held, sizes)
        assert all(sum(goes[t]) == sum(by) for t, by in held.items())
        assert all(f >= 0 and f + sum(g[s] for g in goes.values()) == sizes[s] for s, f in enumerate(free))
