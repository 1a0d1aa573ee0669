"""Approximate nearest neighbours by cross-polytope hashing.

A rotation of three rounds of random signs and fast Hadamard transforms takes a unit vector to its nearest signed axis. A
table's hash is the axes of several rotations, the more the more rows there are (`polytopes`), so buckets stay small as a
table grows. Every valid row is indexed in TABLES tables; a query probes each table's `probes` best buckets, those with the
greatest sums of coordinates along their axes. `probes` is fitted on a bounded sample: SAMPLE queries are compared with every
row (blocks against all rows), and the fewest probes are taken that would have found TARGET of their true neighbours.

The leading axes of a bucket are the key of a shuffle, the other ones are told apart inside the task. Rows of a key are dealt
into blocks of BLOCK_ROWS by a hash, and a query goes to every block of its keys: a key that holds a third of all rows is
many tasks' work. A block answers each query with its k exactly nearest among the rows of probed buckets, so what leaves it
follows the queries, not the candidates. Distances are computed on the original vectors in double precision.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite parts take no part, nor
do rows without vec_id; of rows with equal vectors only the k + 1 smallest ids can be among anyone's nearest, and the
others are not indexed (this is exact); repeated rows (same id and vector) count once; rows of one id with several vectors
are one point, as far from another as the nearest of its vectors; ties go to the smaller vec_id; with fewer than k
candidates all found are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import checkpointed

TABLES = 10
SEED = 20260
SAMPLE = 64
TARGET = 0.93
BLOCK_ROWS = 4096
#: Probes a table at most; beyond them a table's buckets are all but evenly far.
MOST_PROBES = 20_000
#: Found neighbours a task gathers before it leaves out those that cannot be among the nearest.
GATHER = 500_000
K = 10
RESULT = "query_id long, vec_id long, score double"


def rotations(dim: int, tables: int = TABLES, polytopes: int = 1, seed: int = SEED) -> np.ndarray:
    """Signs: tables x polytopes x 3 rounds x the next power of two."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, polytopes, 3, 1 << max(0, dim - 1).bit_length()))


def polytopes(rows: int, axes_each: int) -> tuple[int, int]:
    """How many rotations make a table's hash, and how many of them the key of a shuffle."""
    hashed = max(1, math.floor(math.log(max(2, 16 * rows), axes_each)))
    while hashed > 1 and axes_each**hashed > 2**60:
        hashed -= 1
    keyed = 1
    while keyed < hashed and rows / axes_each**keyed > 4 * BLOCK_ROWS:
        keyed += 1
    return hashed, keyed


@lru_cache
def _signs(n: int) -> np.ndarray:
    """The Hadamard matrix of a power of two."""
    return np.array([[1.0]]) if n == 1 else np.kron(np.array([[1.0, 1.0], [1.0, -1.0]]), _signs(n // 2))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, as the product of two small ones along a row's folded halves."""
    n, width = x.shape
    a = 1 << (width.bit_length() - 1) // 2
    b = width // a
    x = (x.reshape(n * a, b) @ _signs(b)).reshape(n, a, b).transpose(0, 2, 1).reshape(n * b, a) @ _signs(a)
    return x.reshape(n, b, a).transpose(0, 2, 1).reshape(n, width) / np.sqrt(width)


def axes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows against the signed axes of one table: 2 * width columns, the larger the nearer."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    y = np.zeros((len(x), signs.shape[-1]))
    y[:, : x.shape[1]] = x / norm
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], axis=1)


def best_buckets(scores: list[np.ndarray], most: int) -> np.ndarray:
    """The `most` buckets of the greatest sums, best first; scores are one vector's coordinates along each polytope's axes."""
    n = len(scores[0])
    codes = np.argsort(-scores[0], kind="stable")[:most]
    sums = scores[0][codes]
    for s in scores[1:]:
        every = (sums[:, None] + s[None, :]).ravel()
        top = np.argpartition(-every, most - 1)[:most] if len(every) > most else np.arange(len(every))
        top = top[np.argsort(-every[top], kind="stable")]
        codes, sums = codes[top // n] * n + top % n, every[top]
    return codes


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, distance) of the k nearest ids but their own for each query among the rows allowed to it."""
    rough = (rows**2).sum(1)[None, :] - 2 * queries @ rows.T
    rough[own[:, None] == ids[None, :]] = np.inf
    if allowed is not None:
        rough[~allowed] = np.inf
    if rough.shape[1] > k and len(np.unique(ids)) == len(ids):
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        bound = np.where(np.isfinite(kth), kth + 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))), np.finfo(float).max)
        q, r = np.nonzero(rough <= bound[:, None])
    else:
        q, r = np.nonzero(np.isfinite(rough))
    exact = np.sqrt(((rows[r] - queries[q]) ** 2).sum(1))
    return _closest(q, ids[r], exact, k)


def _closest(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct ids of each query, ties to the smaller id."""
    order = np.lexsort((score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.ones(len(q), dtype=bool)
    first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    order = np.lexsort((ids[first], score[first], q[first]))
    q, ids, score = q[first][order], ids[first][order], score[first][order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (floats as they are, other numbers as doubles) of the rows that take part."""
    kept = embeddings.schema["embedding"].dataType == ArrayType(FloatType())
    v = F.col("embedding") if kept else F.col("embedding").cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(finite).dropDuplicates(["vec_id", "v"])


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _found(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """A bounded list of queries against all rows, in blocks."""
    ids, matrix = np.array([q[0] for q in queries]), np.array([q[1] for q in queries], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, near, score = nearest(matrix, _matrix(batch.column(1)), batch.column(0).to_numpy(), ids, k)
                yield _found(ids[q], near, score)

    return _best(rows.select("vec_id", "v").mapInArrow(run, RESULT), k)


def _codes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each row's own bucket in one table."""
    out = np.zeros(len(x), dtype=np.int64)
    for s in signs:
        near = axes(x, s)
        out = out * near.shape[1] + near.argmax(1)
    return out


def fit_probes(rows: DataFrame, queries: DataFrame, signs: np.ndarray, k: int, target: float = TARGET, sample: int = SAMPLE) -> int:
    """The fewest probes a table that find `target` of the true neighbours of at most `sample` queries; the driver
    sees those queries and their k neighbours only."""
    picked = [(r["vec_id"], r["v"]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()]
    if not picked:
        return 1
    true = brute_force(rows, picked, k).select("query_id", "vec_id")
    near = true.join(rows, "vec_id").select("query_id", "v").collect()  # at most sample * k ids
    if not near:
        return 1
    at = {q: i for i, (q, _) in enumerate(picked)}
    q, x = np.array([v for _, v in picked], dtype=np.float64), np.array([r["v"] for r in near], dtype=np.float64)
    of = np.array([at[r["query_id"]] for r in near])
    best = np.full(len(near), MOST_PROBES)
    for table in signs:
        scores, mine = [axes(q, s) for s in table], _codes(x, table)
        for i in range(len(picked)):
            ordered = best_buckets([s[i] for s in scores], MOST_PROBES)
            place = dict(zip(ordered.tolist(), range(len(ordered))))
            for j in np.flatnonzero(of == i):
                best[j] = min(best[j], place.get(int(mine[j]), MOST_PROBES))
    wanted = int(np.sort(best)[max(0, int(np.ceil(target * len(best))) - 1)]) + 1
    if wanted > MOST_PROBES:
        logging.getLogger(__name__).warning("%d probes a table find %.3f of the sample's neighbours, not %.3f", MOST_PROBES, float(np.mean(best < MOST_PROBES)), target)
    return min(MOST_PROBES, wanted)


def search(embeddings: DataFrame, every: int = 100, k: int = K, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    everything = valid(embeddings)
    sizes = everything.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, count = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    everything = checkpointed(everything.where(F.size("v") == dim))
    same = Window.partitionBy("v").orderBy("vec_id")
    rows = everything.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    queries = everything.where(F.col("vec_id") % every == 0)
    width = 2 << max(0, dim - 1).bit_length()  # signed axes
    hashed, keyed = polytopes(count, width)
    inside = width ** (hashed - keyed)
    signs = rotations(dim, tables, hashed)
    kind_of_v = everything.schema["v"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                codes = np.stack([_codes(x, table) for table in signs], axis=1)
                keys = codes // inside + np.arange(tables) * width**keyed
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(c.ravel())) for c in (keys, codes % inside)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["vec_id", "v", "keys", "insides"])

    # rows are hashed once; a row's vector is copied for each table in the shuffle only
    index = checkpointed(rows.mapInArrow(placed, f"vec_id long, v {kind_of_v}, keys array<long>, insides array<long>"))
    probes = probes or fit_probes(index.select("vec_id", "v"), queries, signs, k)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = _matrix(part.column(1))
                for t, table in enumerate(signs):
                    scores = [axes(x, s) for s in table]
                    key, pick, cut = [], [], []
                    for i in range(len(x)):
                        codes = np.sort(best_buckets([s[i] for s in scores], probes))
                        own, first = np.unique(codes // inside, return_index=True)
                        key.append(own + t * width**keyed)
                        pick.append(np.full(len(own), i))
                        cut += np.split(codes % inside, first[1:])
                    edges = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
                    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(cut)))
                    pick = pa.array(np.concatenate(pick))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), part.column(0).take(pick), lists, part.column(1).take(pick)], names=["key", "vec_id", "inside", "v"])

    entry = F.explode(F.arrays_zip("keys", "insides")).alias("e")
    counts = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    # at most tables * width^keyed keys, of which there are more than tables * width only where keys hold thousands of rows each
    counts = checkpointed(counts)
    blocks = F.broadcast(counts) if keyed == 1 else counts
    filed = index.select("vec_id", "v", entry).select(F.col("e.keys").alias("key"), "vec_id", F.array("e.insides").alias("inside"), "v").join(blocks, "key")
    filed = filed.select("key", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "vec_id", "inside", "v")
    asked = queries.mapInArrow(probed, f"key long, vec_id long, inside array<long>, v {kind_of_v}").join(blocks, "key")
    asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "vec_id", "inside", "v")
    parts = filed.unionByName(asked).repartition("key", "block").sortWithinPartitions("key", "block", "kind", "vec_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams blocks: a block's queries come first, then its rows; a block's rows are few."""
        now, held, out, size = None, {0: [], 1: []}, [], 0

        def close() -> Iterator[tuple]:
            if held[0] and held[1]:
                ids, vs, own = (np.concatenate([x[i] for x in held[1]]) for i in (0, 2, 1))
                for ask_id, wanted, ask_v, lengths in held[0]:
                    for a in range(0, len(ask_id), 512):
                        edges = np.concatenate([[0], np.cumsum(lengths)])
                        n = len(ask_id[a : a + 512])
                        asks = np.repeat(np.arange(n), lengths[a : a + 512])
                        codes = wanted[edges[a] : edges[a + n]]
                        there, where = np.unique(own, return_inverse=True)
                        at = np.minimum(np.searchsorted(there, codes), len(there) - 1)
                        hit = there[at] == codes
                        allowed = np.zeros((n, len(there)), dtype=bool)
                        allowed[asks[hit], at[hit]] = True
                        some = np.flatnonzero(allowed.any(axis=1))
                        if len(some):
                            q, near, score = nearest(ask_v[a : a + n][some], vs, ids, ask_id[a : a + n][some], k, allowed[some][:, where])
                            yield ask_id[a : a + n][some][q], near, score

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, kind, vec = (batch.column(i).to_numpy() for i in range(4))
            lists, x = batch.column(4), _matrix(batch.column(5))
            starts = lists.offsets.to_numpy()
            codes, starts = lists.flatten().to_numpy(), starts - starts[0]
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)]):
                if now != (key[a], block[a]):
                    for found in close():
                        out.append(found)
                        size += len(found[0])
                    now, held = (key[a], block[a]), {0: [], 1: []}
                    if size > GATHER:
                        out = [_closest(*(np.concatenate(c) for c in zip(*out)), k)]
                        if (size := len(out[0][0])) > GATHER // 2:
                            yield _found(*out[0])
                            out, size = [], 0
                held[kind[a]].append((vec[a:b], codes[starts[a] : starts[b]], x[a:b], np.diff(starts[a : b + 1])))
        out += list(close())
        if out:
            yield _found(*_closest(*(np.concatenate(c) for c in zip(*out)), k))

    found = _best(parts.mapInArrow(answer, RESULT), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
