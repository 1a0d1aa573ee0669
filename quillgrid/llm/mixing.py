"""Mixing to target weights with soft domain membership, in DataFrame expressions only.

1. A naive Bayes classifier, fitted on at most SAMPLE labelled documents (those with the least hash of doc_id), gives
   every document a posterior over the domains good, poor and toxic. Its features: at most WORDS_PER_DOMAIN telling
   words of each domain (whether any is there, and which), and how varied the words are.
2. Nonnegative rates r are fitted to the expected tokens of each domain, sum of r * tokens * posterior, by projected
   gradient least squares: r = clip(1 - posterior . sum of M (A r - t)), where M inverts the token Gram matrix of the
   documents inside their bounds. One round is one aggregation to a few numbers; a rate is the same function of the
   posterior for every document, so no state is joined. Rounds go on until the totals stand.

Targets may be out of reach: no mix holds more of a domain than the document surest of it. The fit then comes as near as
rates up to `most` can, and says so (`met`).

Cases: null or empty text has no tokens and a rate like any other with its posterior; texts of any length are read
whole; null doc_ids are never labelled; repeated rows count each; a document with several labels takes the worst;
without labels all documents share one posterior; an empty table gives an empty result; other columns are ignored by
`rates` and kept by `mix`.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

DOMAINS = ("good", "poor", "toxic")
#: Shares of the mix. The budget is the one at which the first domain keeps its own tokens.
TARGETS = {"good": 0.98, "poor": 0.015, "toxic": 0.005}
SAMPLE = 20_000
WORDS_PER_DOMAIN = 256
LEAST_SEEN = 4
#: A telling word is at least so many times as frequent in its domain as outside.
TELLS = 2
#: and its count times the log of that ratio is at least this: with some thousand words, a few pass by chance.
SURE = 6.0
LOOKUP = 128
VARIETY = (0.2, 0.35, 0.5, 0.7)
#: Rounds at most; some ten are needed.
ROUNDS = 60
#: The greatest rate unless a caller says otherwise: a text seen more often than this is learnt by heart.
MOST = 4.0
#: How much the targets weigh against rates near 1, and the share of its own target by which a domain may miss it.
STIFF = 1e4
CLOSE = 1e-2
SEED = 61


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    clean = F.coalesce(text, F.lit(""))
    for c in "\n\t\r":
        clean = F.replace(clean, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(clean, " "), "")


def _variety(distinct: Column, words: Column) -> Column:
    share = distinct / F.greatest(F.lit(1), words)
    level = F.lit(len(VARIETY))
    for i, top in reversed(list(enumerate(VARIETY))):
        level = F.when(share < top, F.lit(i)).otherwise(level)
    return level


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Log likelihoods by domain: priors, listed words, whether any word listed for a domain is there, and level of
    variety. The driver sees at most 3 * WORDS_PER_DOMAIN words and a few sums."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(domain).alias("domain"))
    few = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("domain", _words(F.col("text")).alias("all"))
    known = known.select("domain", F.array_distinct("all").alias("w"), F.size("all").alias("n"))
    known = checkpointed(known.select("domain", "w", _variety(F.size("w"), F.col("n")).alias("variety")))
    sums = {(r["domain"], r["variety"]): r["n"] for r in known.groupBy("domain", "variety").agg(F.count("*").alias("n")).collect()}
    size = [sum(n for (d, _), n in sums.items() if d == k) for k in range(3)]
    total = sum(size)
    model = {"prior": [math.log((n + 1) / (total + 3)) for n in size], "words": [{}, {}, {}], "any": {}, "variety": {}}
    for v in range(len(VARIETY) + 1):
        model["variety"][v] = [math.log((sums.get((k, v), 0) + 0.5) / (size[k] + 0.5 * (len(VARIETY) + 1))) for k in range(3)]
    seen = known.select("domain", F.explode("w").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(3)])
    seen = checkpointed(seen.where(F.col("n0") + F.col("n1") + F.col("n2") >= LEAST_SEEN))
    for k in range(3):
        inside = (F.col(f"n{k}") + 0.1) / (size[k] + 1)
        outside = (sum(F.col(f"n{j}") for j in range(3) if j != k) + 0.1) / (total - size[k] + 1)
        # how much a document with the word tells, times how often it does
        tells = F.log(inside / outside) * F.sqrt(inside)
        sure = F.col(f"n{k}") * F.log(inside / outside) >= SURE
        for r in seen.where((inside > TELLS * outside) & sure).orderBy(F.desc(tells), "word").limit(WORDS_PER_DOMAIN).collect():
            model["words"][k][r["word"]] = [math.log((r[f"n{j}"] + 0.5) / (size[j] + 1)) for j in range(3)]
    listed = [F.array(*map(F.lit, sorted(words) or [""])) for words in model["words"]]
    found = known.groupBy("domain", *[F.arrays_overlap("w", listed[k]).alias(f"any{k}") for k in range(3)]).agg(F.count("*").alias("n")).collect()
    for k in range(3):
        for there in (False, True):
            n = [sum(r["n"] for r in found if r["domain"] == j and bool(r[f"any{k}"]) == there) for j in range(3)]
            model["any"][k, there] = [math.log((n[j] + 0.5) / (size[j] + 1)) for j in range(3)]
    return model


def _judged(docs: DataFrame, keep: list[Column], model: dict) -> DataFrame:
    """`keep`, tokens, and p: the domains' posteriors."""
    number = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    listed = sorted({w for words in model["words"] for w in words}) or [""]
    # words and scores by a hash of the word: looking one up in a map or a long array would pass all others
    places: list[dict[str, list[list[float]]]] = [{} for _ in range(LOOKUP)]
    for k, words in enumerate(model["words"]):
        for w, x in sorted(words.items()):
            # being there at all is counted once for a domain's words; a word adds how it differs from its like. A word
            # may be telling for two domains.
            places[zlib.crc32(w.encode()) % LOOKUP].setdefault(w, []).append([k, *[a - b for a, b in zip(x, model["any"][k, True])]])
    words_at = F.array(*[F.array(*map(F.lit, at)).cast("array<string>") for at in places])
    scores_at = F.array(*[F.array(*[F.array(*map(number, x)) for x in at.values()]).cast("array<array<array<double>>>") for at in places])

    def looked_up(w: Column) -> Column:
        place = (F.crc32(w.cast("binary")) % LOOKUP).cast("int")
        return F.get(F.get(scores_at, place), F.array_position(F.get(words_at, place), w).cast("int") - 1)

    # Two projections: the arrays of words in compiled code, and all that is done with what was found as one
    # expression. Compiled into the same method, it would make that too long for the JVM to optimise.
    split = docs.select(*keep, _words(F.col("text")).alias("_all"))
    names = split.columns[:-1]
    found = F.array_intersect("_all", F.array(*map(F.lit, listed)))
    split = split.select(*names, F.size("_all").cast("long").alias("tokens"), F.size(F.array_distinct("_all")).alias("_distinct"), found.alias("_found"))
    levels = F.array(*[number(model["variety"][v]) for v in range(len(VARIETY) + 1)])

    def score(level: Column, by: list[Column], j: int) -> Column:
        z = F.lit(float(model["prior"][j])) + F.get(F.get(levels, level), j)
        for k, hits in zip(range(3), by):
            # the mean of what the words found say, as they seldom are independent
            mean = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x[j + 1]) / F.greatest(F.lit(1), F.size(hits))
            z = z + F.when(F.size(hits) > 0, F.lit(float(model["any"][k, True][j])) + mean).otherwise(F.lit(float(model["any"][k, False][j])))
        return z

    def scores(level: Column, hits: Column) -> Column:
        of = lambda k: F.filter(hits, lambda x: x[0] == k)
        return _let(F.struct(*[of(k).alias(d) for k, d in enumerate(DOMAINS)]), lambda x: F.array(*[score(level, [x[d] for d in DOMAINS], j) for j in range(3)]))

    def judged(x: Column) -> Column:
        hits = F.flatten(F.filter(F.transform(x["_found"], looked_up), lambda h: h.isNotNull()))
        level = _variety(x["_distinct"], x["tokens"])
        odds = _let(_let(hits, lambda h: scores(level, h)), lambda s: _let(F.array_max(s), lambda top: F.transform(s, lambda z: F.exp(F.greatest(F.lit(-60.0), z - top)))))
        return _let(odds, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda z: z / total)))

    return split.select(*names, "tokens", _let(F.struct("_found", "_distinct", "tokens"), judged).alias("p"))


def _members(judged: DataFrame) -> DataFrame:
    """judged with one column for each domain's posterior instead of p."""
    names = [c for c in judged.columns if c != "p"]
    return judged.select(*names, *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)])


def _rate(steps: np.ndarray, most: float) -> Column:
    """The rate of a document: 1 less the steps' sum along its posteriors, projected to 0 ... most."""
    r = F.lit(1.0) - sum(F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, steps))
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r))


@dataclass(frozen=True)
class Fit:
    """What a fit came to: the steps' sum, wanted and reached tokens by domain, and whether those agree."""

    steps: np.ndarray
    wanted: np.ndarray
    reached: np.ndarray
    met: bool


def _totals(members: DataFrame, tried: list[np.ndarray], most: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each of some steps the domains' expected tokens, the Gram matrix of documents within their bounds, and the
    documents' part of the objective: one aggregation to as many numbers as there are pairs of domains."""
    share = [F.col(f"p_{d}") for d in DOMAINS]
    n = len(DOMAINS)
    rated = members.select("tokens", *share, *[_rate(x, most).alias(f"r{k}") for k, x in enumerate(tried)])
    sums = []
    for k in range(len(tried)):
        r = F.col(f"r{k}")
        inside = F.when((r > 0) & (r < most), F.col("tokens")).otherwise(0)
        along = sum(s * float(x) for s, x in zip(share, tried[k]))
        sums += [F.sum(F.col("tokens") * ((r - 1) * (r - 1) / 2 + r * along)).alias(f"v{k}")]
        sums += [F.sum(r * F.col("tokens") * s).alias(f"t{k}{i}") for i, s in enumerate(share)]
        sums += [F.sum(inside * share[i] * share[j]).alias(f"g{k}{i}{j}") for i in range(n) for j in range(i, n)]
    got = rated.agg(*sums).first()
    number = lambda name: float(got[name] or 0)
    return [(np.array([number(f"t{k}{i}") for i in range(n)]), np.array([[number(f"g{k}{min(i, j)}{max(i, j)}") for j in range(n)] for i in range(n)]), number(f"v{k}")) for k in range(len(tried))]


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = ROUNDS, most: float = MOST) -> Fit:
    """Projected gradient least squares over members (tokens, p_<domain>): rates 0 ... most with the least
    |A r - t|^2 + sum of tokens * (r - 1)^2 / STIFF. A round's gradient is scaled by the Gram matrix of the documents
    that are inside their bounds; several lengths of the step are tried in the round's one aggregation."""
    n = len(DOMAINS)
    steps = np.zeros(n)
    now, gram, _ = _totals(members, [steps], most)[0]
    total = now.sum()
    if not total:
        return Fit(steps, now, now, True)
    wanted = np.array([targets[d] for d in DOMAINS]) * now[0] / targets[DOMAINS[0]]
    for _ in range(rounds):
        slope = steps / STIFF - (now - wanted) / total
        if np.abs(slope).max() < 1e-9:
            break
        step = np.linalg.solve(np.eye(n) / STIFF + gram / total, slope)
        tried = [steps - step * k for k in (1.0, 0.3, 0.05)]
        found = _totals(members, tried, most)
        # the convex function whose slope that is
        height = lambda k: float(tried[k] @ tried[k] / 2 / STIFF + (tried[k] @ wanted - found[k][2]) / total)  # noqa: B023, E731
        best = min(range(len(tried)), key=height)
        stands = np.abs(found[best][0] - now).max() < 1e-7 * total
        steps, (now, gram, _) = tried[best], found[best]
        if stands:
            break
    return Fit(steps, wanted, now, bool((np.abs(now - wanted) <= CLOSE * wanted).all()))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = MOST) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate for each document, and in every row what the fit came to: wanted_<domain> and
    reached_<domain> (expected tokens), and met: whether each domain is within CLOSE of its own target (false where no rates
    up to `most` can)."""
    members = checkpointed(_members(_judged(docs, [F.col("doc_id")], fit_classifier(docs, labels))))
    fit = fit_rates(members, targets, most=most)
    return members.select("doc_id", "tokens", *[f"p_{d}" for d in DOMAINS], _rate(fit.steps, most).alias("rate"), F.lit(fit.met).alias("met"), *[F.lit(float(x)).alias(f"{name}_{d}") for name, xs in (("wanted", fit.wanted), ("reached", fit.reached)) for d, x in zip(DOMAINS, xs)])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = MOST) -> DataFrame:
    """docs, all columns as they were, each row as often as its rate says: the whole part of the rate, and once more
    where a hash of the row's number falls below the rest. Sums over the domains stay at their targets by that."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Texts are judged once. As Parquet the fit reads its few columns only.
    judged = written(_members(_judged(docs, [row], fit_classifier(docs, labels))).withColumn("nth", F.monotonically_increasing_id()))
    fit = fit_rates(judged.select("tokens", *[f"p_{d}" for d in DOMAINS]), targets, most=most)
    if not fit.met:
        shares = [", ".join(f"{d} {x / max(1.0, xs.sum()):.4f}" for d, x in zip(DOMAINS, xs)) for xs in (fit.wanted, fit.reached)]
        logging.getLogger(__name__).warning("no rates up to %s reach the targets: wanted %s, reached %s", most, *shares)
    rate = _rate(fit.steps, most)
    chance = F.pmod(F.xxhash64("nth", F.lit(SEED)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    times = F.floor(rate + 1 - chance).cast("int")
    return judged.select("row", times.alias("times")).where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
