"""N-gram Jaccard self-join: which documents have word 5-gram sets of similarity 0.8 or more, by a MinHash LSH forest.

1. Documents with equal 5-gram sets are one node (with its number of copies).
2. The forest: TREES prefix tries over signatures of DEPTH MinHash values each. A trie's subtrees below the shortest prefix
   that may be needed are dealt to tasks and read there in the order of their signatures; two nodes meet at the length of
   the longest prefix they share in any tree. Pairs whose whole signatures could not come from similar sets are left out.
3. Prefixes begin long and are shortened step by step. A pair whose signatures agree in a share s had the chance
   1 - (1 - s^length)^TREES to be met so far; when the pairs met, each counted by one over that chance, say that RECALL of
   all is met (and a pair just at the threshold would be with chance LEAST), shortening ends. At the shortest length even
   such a pair is met with chance RECALL.
4. The pairs met are verified exactly on their whole 5-gram sets. For that every node has one home, a block of the largest
   subtree it is in, and blocks with nodes that met are compared: a set is sent as often as its block has partners, not
   trees or pairs, and no pair is looked at twice. What leaves a pair of blocks is a count of links and an edge for each
   node, never the pairs. Nothing is compared but blocks that met: chains of similar texts stay apart until the links
   themselves are put together.

Words are runs of anything but the six ASCII white-space characters. A text of one to four words is one n-gram; texts
without words form one group of copies. Links count documents: copies of a text link to one another and to all copies
of a similar one.

Cases: null and empty texts have no words; very long texts are read whole; null or repeated doc_ids and repeated rows
are separate documents; a class is named by its smallest doc_id (null if it has none); an empty table gives an empty
result; other columns are ignored by `classes` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, salted

WIDTH = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 6
#: Share of links to find, and the least chance of a pair at the threshold at the length shortening may end.
RECALL, LEAST = 0.99995, 0.995
#: Chance to lose a pair at the threshold by looking at its signatures first.
LOSS = 1e-5
#: Nodes of a subtree's block, and nodes and n-grams of a home block.
SUBTREE_BLOCK, BLOCK, BLOCK_GRAMS = 1536, 384, 4_000_000
#: Pairs looked at at a time inside a task.
PAIRS = 200_000
#: Of how many copies on a class is joined by broadcast: more than a thousandth of all rows, and more than this.
HOT = 1000
SEED = 977
CACHE_WORDS = 400_000

_A = np.random.default_rng(SEED).integers(1, 2**63, size=TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_WORDS = _Words()


def _mix(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    k = min(width, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = _mix(h, _M1) + ids[j : j + n - k + 1]
    return np.unique(_mix(h, _M2))


def signature(s: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of TREES * DEPTH hash functions."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (s[None, at : at + 2048] * _A[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def meets(similarity: float | np.ndarray, length: int) -> float | np.ndarray:
    """The chance to share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** TREES


def lengths(threshold: float) -> list[int]:
    """The prefix lengths to go through, from the longest at which a pair at the threshold meets with chance LEAST to the
    longest at which it does with chance RECALL."""
    reach = lambda wanted: max((d for d in range(1, DEPTH + 1) if meets(threshold, d) >= wanted), default=1)
    return list(range(reach(LEAST), reach(RECALL) - 1, -1))


def least_equal(threshold: float) -> int:
    """How many signature values a pair at the threshold shares but for a chance of LOSS."""
    n, below = TREES * DEPTH, 0.0
    for k in range(n + 1):
        below += comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if below > LOSS:
            return k
    return n


def _chained(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) that connect each component of a symmetric boolean matrix, as paths: no node has many."""
    done, one, other = np.zeros(len(linked), dtype=bool), [], []
    for i in np.flatnonzero(linked.any(axis=0)):
        if not done[i]:
            part = edge = np.array([i])
            done[i] = True
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & ~done)
                done[edge] = True
                part = np.concatenate([part, edge])
            one.append(part[:-1])
            other.append(part[1:])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *other])


def _heads(one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes: the first of the path of `_chained` that it is on, which is its least; itself, if on none."""
    heads, starts = np.arange(n), np.ones(len(one), dtype=bool)
    starts[1:] = one[1:] != other[:-1]
    heads[other] = one[starts][np.cumsum(starts) - 1]
    return heads


def _jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Exact similarities of all pairs of a block's sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # n-grams of a single set take no part in any intersection
    owner, column = owner[shared], column[shared]
    both = np.zeros((n, n))
    if len(column):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]))
        step = max(64, 4_000_000 // n)
        for at in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [at, at + step])
            x = np.zeros((n, min(step, int(column[-1]) + 1 - at)), dtype=np.float32)
            x[owner[a:b], column[a:b] - at] = 1
            both += x @ x.T
    return both / np.maximum(1, sizes[:, None] + sizes[None, :] - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows that are equal in the first `keys` columns, as (key, columns); the input is sorted by them."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:keys] != now:
                if held:
                    yield now, list(map(list, zip(*held)))
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, list(map(list, zip(*held)))


def _sides(mine: list[int], a: int, b: int) -> np.ndarray:
    """Which pairs of a block pair count: inside (a, a) all, in (a, b) those across."""
    side = np.array(mine)
    return np.ones((len(side), len(side)), dtype=bool) if a == b else side[:, None] != side[None, :]


def _block_pairs(df: DataFrame, key: str) -> DataFrame:
    """Each row once for every pair of blocks (a, b), a <= b, that its block takes part in; `blocks` tells how many."""
    cut = df.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other"))
    # by ranges: the block pairs of one large key are dealt evenly
    return cut.repartitionByRange(key, "a", "b").sortWithinPartitions(key, "a", "b", "bits", "node")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label (the component's smallest node) for all nodes of edges (node, to), by spreading least labels and
    jumping to labels' labels, until nothing changes: labels only fall, so it ends. known (node, label): a node of each node's
    component to begin with, not larger than itself; the nearer it is to the smallest, the fewer rounds there are."""
    both = checkpointed(edges.select("node", "to").union(edges.select("to", "node")).distinct())
    labels = checkpointed(known if known is not None else both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # where a label's node has a smaller label by now
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further")).where("label != further")
        jump = jump.join(labels.select("label").distinct(), "label")
        after = checkpointed(salted(spread, jump, ["label"], ["node"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, s1, s2 (the set of n-grams), n (its size) and sig; one row for each document, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, size, sig = [], [], [], []
            for x in batch.column(3):
                s = shingles(x.as_py())
                s1.append(int(_mix(s, _M1).sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(_mix(s, _M3).sum(dtype=np.uint64).astype(np.int64)))
                size.append(len(s))
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "k1", "k2", "s1", "s2", "n", "sig"])
        _WORDS.clear()  # idle workers hold no words

    return _texts(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, s1 long, s2 long, n long, sig binary")


def _prefixes(sig: np.ndarray, length: int) -> np.ndarray:
    """Nodes x trees: a hash of the tree and the first values of each signature there."""
    h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2])
    for d in range(length):
        h = _mix(h, _M1) + sig[:, :, d].astype(np.uint64)
    return _mix(h, _M2)


def _signatures(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), TREES, DEPTH)


def _subtrees(nodes: DataFrame, length: int) -> DataFrame:
    """key, tree, size, node: the nodes of each subtree below a prefix of this length that holds two or more. Of subtrees with
    the very same nodes the first tree's is taken."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = _prefixes(_signatures(batch.column(1).to_pylist()), length)
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, t].astype(np.int64)), pa.array(np.full(len(h), t, dtype=np.int32)), batch.column(0)], names=["key", "tree", "node"])

    entries = checkpointed(nodes.where("n > 0").select("node", "sig").mapInArrow(prefixes, "key long, tree int, node long"))
    met = entries.groupBy("key", "tree").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("who")).where("size > 1")
    once = met.groupBy("size", "who").agg(F.min(F.struct("tree", "key")).alias("first"))
    return checkpointed(salted(entries, once.select("first.key", "first.tree", "size"), ["key", "tree"], ["node"]))


def _homes(subtrees: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, home (a block of the largest subtree the node is in), bits: the low byte of each signature value."""
    home = subtrees.groupBy("node").agg(F.max(F.struct("size", (-F.col("tree")).alias("tree"), "key")).alias("at")).select("node", F.col("at.key").alias("key"))
    home = home.join(nodes.select("node", "n", "sig"), "node")
    blocks = home.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([np.frombuffer(x, dtype=np.uint32).astype(np.uint8).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], names=["node", "home", "bits"])

    placed = salted(home, blocks, ["key"], ["node"]).select("node", F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("home"), "sig")
    return checkpointed(placed.mapInArrow(low, "node long, home long, bits binary"))


def _met(codes: np.ndarray, steps: list[int], tree: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of nodes: the place in `steps` of the longest prefix they share in any tree (that many if of none), and
    whether `tree` is the first where they share the shortest. codes: nodes x trees x depth, one byte each."""
    at, first = np.full(len(i), len(steps), dtype=np.int8), np.ones(len(i), dtype=bool)
    for k in range(len(steps) - 1, -1, -1):
        words = sum(codes[:, :, d].astype(np.uint64) << np.uint64(8 * d) for d in range(steps[k]))
        same = words[i] == words[j]
        at[same.any(axis=1)] = k
        if k == len(steps) - 1:
            first = same[:, tree] & ~same[:, :tree].any(axis=1)
    return at, first


def _partners(subtrees: DataFrame, homes: DataFrame, threshold: float, steps: list[int]) -> DataFrame:
    """home, other: home blocks with nodes that met and may be similar, home <= other; at: the place in `steps` of the longest
    prefix of such a meeting. In rows without home, of pairs that seem similar, m0, m1, ...: those met at each length, and
    w0, w1, ...: those, each by one over its chance to be met at that length or before."""
    members = subtrees.withColumn("blocks", F.ceil(F.col("size") / SUBTREE_BLOCK).cast("int")).join(homes, "node")
    values = TREES * DEPTH
    enough, seems = least_equal(threshold), threshold * values
    # by how many values are equal: one over the chance to be met at each length
    weight = [1 / np.maximum(meets(np.arange(values + 1) / values, d), 1e-9) for d in steps]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), (tree, home, bits, mine) in _groups(batches, 3):
            x = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(home), values)
            equal = np.zeros((len(home), len(home)), dtype=np.uint8)
            for c in x.T:
                equal += c[:, None] == c[None, :]
            i, j = np.nonzero(np.triu((equal >= enough) & _sides(mine, a, b), 1))
            if not len(i):
                continue
            codes = x.reshape(len(home), TREES, DEPTH)
            blocks, block = np.unique(np.array(home), return_inverse=True)
            least = np.full((len(blocks), len(blocks)), len(steps), dtype=np.int8)
            counts, weights = np.zeros(len(steps), dtype=np.int64), np.zeros(len(steps))
            for c in range(0, len(i), PAIRS):
                p, q = i[c : c + PAIRS], j[c : c + PAIRS]
                at, first = _met(codes, steps, tree[0], p, q)
                np.minimum.at(least, (np.minimum(block[p], block[q]), np.maximum(block[p], block[q])), at)
                similar = equal[p, q]
                counted = first & (similar >= seems)
                for k in range(len(steps)):
                    counts[k] += (counted & (at == k)).sum()
                    weights[k] += weight[k][similar[counted & (at <= k)]].sum()
            n, other = np.nonzero(least < len(steps))
            sums = [pa.array(np.append(np.zeros(len(n), dtype=np.int64), v)) for v in counts]
            sums += [pa.array(np.append(np.zeros(len(n)), v)) for v in weights]
            last = np.arange(len(n) + 1) == len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(blocks[n], 0), mask=last), pa.array(np.append(blocks[other], 0)), pa.array(np.append(least[n, other], 0).astype(np.int32)), *sums], names=["home", "other", "at", *ms, *ws])

    ms, ws = [f"m{k}" for k in range(len(steps))], [f"w{k}" for k in range(len(steps))]
    layout = "home long, other long, at int, " + ", ".join([f"{m} long" for m in ms] + [f"{w} double" for w in ws])
    pairs = _block_pairs(members, "key").select("key", "a", "b", "tree", "home", "bits", "mine").mapInArrow(compare, layout)
    return pairs.groupBy("home", "other").agg(F.min("at").alias("at"), *[F.sum(c).alias(c) for c in (*ms, *ws)])


def _shortened(partners: DataFrame, steps: list[int]) -> int:
    """The place in `steps` of the length where enough pairs are met."""
    n = len(steps)
    sums = partners.agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(n)], *[F.sum(f"w{k}").alias(f"w{k}") for k in range(n)]).first()
    met = 0
    for k in range(n):
        met += sums[f"m{k}"] or 0
        if met and met >= RECALL * sums[f"w{k}"]:
            return k
    return n - 1


def _sets(docs: DataFrame, nodes: DataFrame, homes: DataFrame, partners: DataFrame) -> DataFrame:
    """home, node, copies, s: the whole n-gram sets of the nodes of blocks that met any."""
    met = partners.select("home").union(partners.select("other")).distinct()
    wanted = homes.select("node", "home").join(met, "home").join(nodes, "node").select("home", "node", "k1", "k2", "copies")
    found = _texts(docs).select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shingles(x.as_py()).tobytes() for x in batch.column(3)], pa.large_binary())], names=["home", "node", "copies", "s"])
        _WORDS.clear()

    return found.select("home", "node", "copies", "text").mapInArrow(cut, "home long, node long, copies long, s binary")


def _verified(sets: DataFrame, partners: DataFrame, threshold: float) -> DataFrame:
    """For each pair of home blocks and node that has links there: node, links (documents linked to it), to (the end of an
    edge, or null) and least (the smallest node that the links of this pair of blocks connect it with, or itself)."""
    sides = F.explode(F.array_distinct(F.array("a", "b"))).alias("home")
    pairs = partners.select(F.col("home").alias("a"), F.col("other").alias("b")).select("a", "b", sides)
    members = pairs.join(sets, "home").withColumn("mine", (F.col("home") == F.col("b")).cast("int")).repartitionByRange("a", "b").sortWithinPartitions("a", "b", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b), (node, copies, s, mine) in _groups(batches, 2):
            close = (_jaccard([np.frombuffer(x, dtype=np.uint64) for x in s]) >= threshold - 1e-12) & _sides(mine, a, b)
            np.fill_diagonal(close, False)
            links, n = close @ np.array(copies, dtype=np.int64), np.array(node)
            one, other = _chained(close)
            to, at = np.full(len(n), -1), np.flatnonzero(links)
            to[one] = other
            least = n[_heads(one, other, len(n))]  # members come in the order of their nodes
            yield pa.RecordBatch.from_arrays([pa.array(n[at]), pa.array(links[at]), pa.array(n[to[at]], mask=to[at] < 0), pa.array(least[at])], names=["node", "links", "to", "least"])

    return members.select("a", "b", "node", "copies", "s", "mine").mapInArrow(verify, "node long, links long, to long, least long")


def _links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """node, links, to, least: all verified links."""
    steps = lengths(threshold)
    subtrees = _subtrees(nodes, steps[-1])
    homes = _homes(subtrees, nodes)
    partners = checkpointed(_partners(subtrees, homes, threshold, steps))
    partners = partners.where(f"home is not null and at <= {_shortened(partners, steps)}")
    return checkpointed(_verified(checkpointed(_sets(docs, nodes, homes, partners)), partners, threshold))


def _joined(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, k1, k2, s1, s2), and nodes (s1, s2, copies, n_links, head: the class's first (doc_id, k1, k2))."""
    signed = checkpointed(_signed(docs))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    nodes = signed.groupBy("s1", "s2", "n").agg(F.count("*").alias("copies"), F.min(first).alias("f"), F.min("sig").alias("sig"))
    nodes = checkpointed(nodes.select("s1", "s2", "n", "copies", "f", "f.k1", "f.k2", "sig", F.monotonically_increasing_id().alias("node")))
    found = _links(docs, nodes, threshold)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a path through a group of near copies takes many rounds to walk, but its nodes know its least one from the start
    labels = components(found.where("to is not null"), found.groupBy("node").agg(F.min("least").alias("label")))
    named = nodes.join(links, "node", "left").join(labels, "node", "left")
    named = checkpointed(named.select("s1", "s2", "copies", "f", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "label"))
    heads = named.where("label is not null").groupBy("label").agg(F.min("f").alias("head"))
    linked = salted(named.where("label is not null"), heads, ["label"], ["s1", "s2"])
    columns = ["s1", "s2", "copies", "n_links", "head"]
    every = linked.select(*columns).unionByName(named.where("label is null").withColumn("head", F.col("f")).select(*columns))
    return signed.select("doc_id", "k1", "k2", "s1", "s2"), checkpointed(every)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest doc_id of all that links of similarity >= threshold
    connect) and n_links (documents linked directly, copies among them)."""
    rows, nodes = _joined(docs, threshold)
    nodes = nodes.select("s1", "s2", "copies", F.col("head.doc_id").alias("class_id"), "n_links")
    most = max(HOT, rows.count() // 1000)
    # at most a thousand sets have that many copies
    hot = nodes.where(F.col("copies") > most).select("s1", "s2", F.col("class_id").alias("hot_id"), F.col("n_links").alias("hot_links"))
    told = rows.select("doc_id", "s1", "s2").join(F.broadcast(hot), ["s1", "s2"], "left")
    rest = told.where("hot_links is null").select("doc_id", "s1", "s2").join(nodes.where(F.col("copies") <= most), ["s1", "s2"])
    return told.where("hot_links is not null").select("doc_id", F.col("hot_id").alias("class_id"), F.col("hot_links").alias("n_links")).unionByName(rest.select("doc_id", "class_id", "n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they were, that are first (by doc_id) in their class; of equal rows one."""
    _, nodes = _joined(docs, threshold)
    heads = nodes.select(F.col("head.k1").alias("k1"), F.col("head.k2").alias("k2")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(row.alias("row"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")).join(heads, ["k1", "k2"])
    w = Window.partitionBy("k1", "k2").orderBy(F.xxhash64("row"))
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("row.*")
