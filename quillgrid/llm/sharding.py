"""Sharding by balanced label propagation: documents that are linked (equal texts) move to one another's shards.

Every document begins in a shard dealt by number, so that shard sizes differ by one at most. Then the texts vote for
shards with their counts by (text, shard):
1. Large texts, of more than rows / (shards * PARTS) rows, vote together before all others: largest first, each takes
   the shard that holds most of it among those with room for it; one beyond a shard's size fills as few shards as it can.
   The other documents are dealt to the places left.
2. In each round the documents of a smaller text ask to move to the shard that holds most of their text; quotas admit as
   many as the shard can take in exchange, unlinked documents fill the gaps the other way, and the sizes stay as they
   were: the law `rows`.
Rows of large texts are joined by broadcast, all others meet their text's row in several places, and numberings and parts
hold a bounded number of rows, so no key's rows come together in a task. DataFrame operations only; the driver sees nothing but the (shard x shard) table of requests and the (large text x shard) table of counts.

Cases: null text is empty (size 1); null, equal or repeated doc_ids are placed row by row; ties between shards go to
the one the text's hash names, then to the higher number; fewer rows than shards leave shards empty; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, checkpointed, numbered, salted

SHARDS = 8
ROUNDS = 3
#: A text of more than rows / (shards * PARTS) rows is large; only one larger than a shard is cut into parts.
PARTS = 16
#: Rows of a part at most, and of a text that ask to move together.
PART_ROWS = 100_000


def quotas(asked: dict[tuple[int, int], int], single: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """From requests by (from, to) and unlinked documents by shard: how many of each may move so that no size changes."""
    n = len(single)
    move = [[asked.get((s, t), 0) if s != t else 0 for t in range(n)] for s in range(n)]
    gain = lambda t: sum(move[s][t] for s in range(n)) - sum(move[t])
    for _ in range(8 * n * n):
        t = max(range(n), key=lambda t: gain(t) - single[t])
        if (excess := gain(t) - single[t]) <= 0:
            break
        s = max(range(n), key=lambda s: move[s][t])
        move[s][t] -= min(excess, move[s][t])
    else:
        move = [[min(asked.get((s, t), 0), asked.get((t, s), 0)) if s != t else 0 for t in range(n)] for s in range(n)]
    fill = [[0] * n for _ in range(n)]
    surplus = [gain(t) for t in range(n)]
    for s in range(n):
        for t in range(n):
            if surplus[s] > 0 > surplus[t]:
                k = min(surplus[s], -surplus[t])
                fill[s][t] = k
                surplus[s] -= k
                surplus[t] += k
    return move, fill


def places(held: dict[int, list[int]], sizes: list[int]) -> tuple[dict[int, list[int]], list[int]]:
    """How many rows of each text (its rows by shard) go to each shard of these sizes, and the places left."""
    free, out = list(sizes), {}
    for text, by in sorted(held.items(), key=lambda x: (-sum(x[1]), x[0])):
        left, out[text] = sum(by), [0] * len(sizes)
        while left:
            fit = [s for s in range(len(sizes)) if free[s] >= left]
            s = max(fit, key=lambda s: (by[s], free[s], s)) if fit else max(range(len(sizes)), key=lambda s: (free[s], by[s], s))
            n = min(left, free[s])
            out[text][s] += n
            free[s] -= n
            left -= n
    return out, free


def _dealt(number: str, counts: list[int]) -> Column:
    """The shard of a row by its number: the first counts[0] rows to shard 0, and so on."""
    out, upto = F.lit(0), sum(counts)
    for s in range(len(counts) - 1, -1, -1):
        out = F.when(F.col(number) < upto, F.lit(s)).otherwise(out)
        upto -= counts[s]
    return out


def _settled(state: DataFrame, shards: int, rows: int) -> DataFrame:
    """state with the rows of large texts where they stay, and the others dealt to the places left."""
    columns = state.columns
    held: dict[int, list[int]] = {}
    # fewer than shards * PARTS texts are large
    for r in state.where("large").groupBy("text_id", "shard").agg(F.count("*").alias("n")).collect():
        held.setdefault(r["text_id"], [0] * shards)[r["shard"]] = r["n"]
    if not held:
        return state
    goes, free = places(held, [rows // shards + (s < rows % shards) for s in range(shards)])
    plan = state.sparkSession.createDataFrame([(t, by) for t, by in goes.items()], "text_id long, goes array<long>")
    # numbers within a text, and how many rows of it go to this shard or one before
    # a text may hold a third of all rows; fewer than shards * PARTS texts are numbered so
    large = numbered(state.where("large"), ["text_id"], ["rid"], "k", buckets=min(buckets_for(rows), 4096)).join(F.broadcast(plan), "text_id")
    upto = [sum((F.get("goes", j) for j in range(1, s + 1)), F.get("goes", 0)) for s in range(shards)]
    home = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        home = F.when(F.col("k") < upto[s], F.lit(s)).otherwise(home)
    others = numbered(state.where("not large"), [], ["rid"], "k", buckets=buckets_for(rows)).withColumn("shard", _dealt("k", free))
    return checkpointed(large.withColumn("shard", home).select(*columns).unionByName(others.select(*columns)))


def propagate(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, text_id, copies (rows of the same text), unit (a text, or a part of one larger than a
    shard), linked (rows of the unit) and shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = checkpointed(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    rows = base.count()
    share, most = max(1, rows // (shards * PARTS)), -(-rows // shards)
    # fewer than shards * PARTS groups are as large as that, so they can be sent to every task
    large = base.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > share)
    parts = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / min(share, PART_ROWS)))).otherwise(F.lit(0))
    state = base.join(F.broadcast(large), ["h1", "h2"], "left").withColumn("text_id", F.xxhash64("h1", "h2")).withColumn("part", F.xxhash64("h1", "h2", parts))
    state = numbered(state.select("rid", "doc_id", "size", "text_crc32", "text_id", "part", "n"), [], ["rid"], "i", buckets=buckets_for(rows))
    state = state.select("rid", "doc_id", "size", "text_crc32", "text_id", "part", "n", F.pmod("i", F.lit(shards)).cast("int").alias("shard"))
    alike = state.groupBy("part").agg(F.count("*").alias("alike"))
    state = salted(state, alike, ["part"], ["rid"]).withColumn("copies", F.coalesce("n", "alike"))
    whole = F.col("copies") <= most
    state = state.withColumn("unit", F.when(whole, F.col("text_id")).otherwise(F.col("part"))).withColumn("linked", F.when(whole, F.col("copies")).otherwise(F.col("alike")))
    state = checkpointed(state.select("rid", "doc_id", "size", "text_crc32", "text_id", "copies", "unit", "linked", F.col("n").isNotNull().alias("large"), "shard"))
    if rounds:
        state = _settled(state, shards, rows)
    for _ in range(rounds):
        voting = state.where("copies > 1 and not large")
        held = voting.groupBy("unit", "shard").agg(F.count("*").alias("n"))
        named = F.pmod(F.xxhash64("unit"), F.lit(shards)) == F.col("shard")
        wanted = held.groupBy("unit").agg(F.max(F.struct("n", named.alias("named"), "shard")).alias("best"), F.count("*").alias("over"))
        wanted = wanted.where("over > 1").select("unit", F.col("best.shard").alias("to"))
        told = salted(voting, wanted, ["unit"], ["rid"], "left").withColumn("to", F.when(F.col("to") != F.col("shard"), F.col("to")))
        asking = checkpointed(told.unionByName(state.where("copies = 1 or large").withColumn("to", F.lit(None).cast("int"))))
        seen = asking.groupBy("shard", "to", (F.col("copies") == 1).alias("single")).agg(F.count("*").alias("n")).collect()  # at most shards * (shards + 2) rows
        asked = {(r["shard"], r["to"]): r["n"] for r in seen if r["to"] is not None}
        if not asked:
            state = asking.drop("to")
            break
        single = [0] * shards
        for r in seen:
            if r["single"]:
                single[r["shard"]] += r["n"]
        move, fill = quotas(asked, single)
        # a unit's rows go together, as far as PART_ROWS of them
        split = asking.where("to is not null").withColumn("some", F.pmod(F.xxhash64("rid"), F.ceil(F.col("linked") / PART_ROWS)))
        movers = numbered(split, ["shard", "to"], ["unit", "rid"], "k", spread=["unit", "some"], buckets=buckets_for(rows))
        allowed = F.element_at(F.array(*[F.lit(move[s][t]) for s in range(shards) for t in range(shards)]), F.col("shard") * shards + F.col("to") + 1)
        movers = movers.withColumn("shard", F.when(F.col("k") < allowed, F.col("to")).otherwise(F.col("shard")))
        fillers = numbered(asking.where("copies = 1"), ["shard"], ["rid"], "k", buckets=buckets_for(rows))
        goes = F.col("shard")
        for s in range(shards):
            done = 0
            for t in range(shards):
                if fill[s][t]:
                    goes = F.when((F.col("shard") == s) & (F.col("k") >= done) & (F.col("k") < done + fill[s][t]), F.lit(t)).otherwise(goes)
                    done += fill[s][t]
        fillers = fillers.withColumn("shard", goes)
        rest = asking.where("to is null and copies > 1")
        columns = state.columns
        state = checkpointed(movers.select(*columns).unionByName(fillers.select(*columns)).unionByName(rest.select(*columns)))
    return state.select("rid", "doc_id", "size", "text_crc32", "text_id", "copies", "unit", "linked", "shard")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row, counted by text: linked documents, those of them outside the shards that hold most of their text (as many
    shards as the text needs at least), and pairs of equal texts in different shards."""
    most = placed.groupBy("shard").agg(F.count("*").alias("rows")).agg(F.max("rows").alias("most"))
    held = placed.where("copies > 1").groupBy("text_id", "shard").agg(F.count("*").alias("n"))
    by_text = held.groupBy("text_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("n"), asc=False).alias("held")).crossJoin(F.broadcast(most))
    needed = F.slice("held", F.lit(1), F.ceil(F.col("n") / F.col("most")).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    pairs = (F.col("n") * F.col("n") - total(F.transform("held", lambda x: x * x))) / 2
    return by_text.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name) for name, x in (("linked", F.col("n")), ("cut", F.col("n") - total(needed)), ("cut_pairs", pairs))])


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (0, 1, 2, ... in each shard) and grown_shard (null under this law)."""
    state = propagate(docs, shards, rounds)
    placed = numbered(state, ["shard"], ["rid"], "slot", buckets=buckets_for(state.count()))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
