"""Personal data by weak supervision, in DataFrame expressions only.

1. Regular expressions propose spans: the strict ones of each kind, and loose ones (spelt-out mail addresses, defanged and
   long network addresses, card numbers in other groups, national phone numbers). Every proposed span carries the votes of
   five labelers: format rule, gazetteer (endings and providers, public network blocks, issuers' prefixes, calling codes),
   context words before it, its neighbours, and its grouping; and three features of its own that do not vote.
2. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each kind and each
   pattern's posterior. The table of patterns is bounded by kinds x strict/loose x 3^5 x 2^3 rows, whatever the input; only
   it reaches the driver.
3. Those posteriors train a logistic span classifier over votes by kind and features, which decides on the loose spans.
   Strict spans that pass their check always stay; strict ones that fail it are never added.

Offsets are code points, ends exclusive. A match's place is the length of all that was split off before it, so a text
is read a fixed number of times whatever it holds. The patterns are written so that no text makes the matcher go back
over more than one run of characters.

Cases: null or empty text has no spans; texts of any length are read whole; null, equal or repeated doc_ids are
handled row by row; spans of different kinds may overlap, and equal starts are ordered by kind as listed; an empty
table gives an empty result and an untrained classifier, which adds nothing; other columns are ignored by
`find_spans` and kept by `redact_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Possessive quantifiers and the guards before runs change no match, only the time a text can take.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose patterns: what people write to be read, not parsed.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[](?i:dot)[)\]]\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[(\[](?:\.|(?i:dot))[)\]]\x20?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:(?:\.|/|_|\x20[\x20-]\x20?)[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,5}){2,4})(?![0-9-])",
}
#: Gazetteers (fixed values).
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br")
PROVIDERS = "gmail|googlemail|outlook|hotmail|live|yahoo|icloud|me|aol|gmx|web|proton|protonmail|mail|orange|free|laposte|t-online|libero|qq|163|yandex"
#: Blocks of addresses that name no one: this network, private, loopback, link, multicast and reserved ones.
RESERVED = r"^0*(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*192\.0*168\."
ISSUERS = "^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|35[2-8]|6011|62|64[4-9]|65)"
CALLING = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
CUES = {
    "email": "e-?mail|contact|write|reach|correo|courriel|kontakt|mailto",
    "ip": "\\bip\\b|host|server|address|addr|client|remote",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel\\b|tel[.:]|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono",
}
AGAINST = "version|\\bv\\.?$|order|invoice|isbn|issn|serial|section|figure|table|article|\\bno\\.|#|§|[$€£]"
CONTEXT = 40
VOTES = ("format", "gazetteer", "context", "neighbours", "grouping")
FEATURES = ("spaced", "leading", "figures")
ADD_AT = 0.9
BLOCK = 512


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.floor(c.try_cast("int") * 2 / 10).cast("int") + c.try_cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; inside a lambda an expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def _located(text: Column, pattern: str) -> Column:
    """Matches in order: g (characters split off before it), m, before (the end of those), after (the start of what follows)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def around(gaps: Column) -> Column:
        return F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("g"), m.alias("m"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))

    return _let(F.split(text, pattern, -1), around)


_PLACED = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def _placed(parts: Column) -> Column:
    """The parts with start and end, summed block by block: appending to one long array would take quadratic time."""

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + x["g"]
        end = start + F.length(x["m"])
        new = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("pos"), F.concat(a["out"], F.array(new)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["pos"].alias("pos"), F.array().cast(_PLACED).alias("out")), step)
        return _let(inner, lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return _let(parts, lambda known: _summed(known, block))


def _summed(parts: Column, block: Callable[[Column, Column], Column]) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / BLOCK).cast("int") - 1), lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)))
    summed = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{_PLACED}>").alias("out")), block)
    return F.when(F.size(parts) > 0, F.flatten(summed["out"])).otherwise(F.array().cast(_PLACED))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _judge(kind: str, strict: bool) -> Callable[[Column], Column]:
    return lambda x: _judged(kind, strict, x)


def _judged(kind: str, strict: bool, x: Column) -> Column:
    """A located match with its votes."""
    m, before, after = x["m"], F.lower(x["before"]), x["after"]
    passes = _passes(kind, m) if strict else F.lit(False)
    edge = before.rlike("[\\p{L}\\p{N}]$") | after.rlike("^[\\p{L}\\p{N}]")
    if kind == "email":
        parts = F.split(F.lower(m), r"[@.\x20()\[\]]+")
        listed = F.element_at(parts, -1).isin(*DOMAINS) | F.get(parts, F.size(parts) - 2).rlike(f"^(?:{PROVIDERS})$")
        gazetteer, grouping = _vote(listed, ~listed), _vote(m.rlike(r"^[A-Za-z0-9]"), m.rlike(r"^[._%+-]"))
    elif kind == "ip":
        dotted = F.regexp_replace(m, r"[^0-9.]", "")
        reserved = dotted.rlike(RESERVED)
        gazetteer, grouping = _vote(~reserved, reserved), _vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        whole = m.rlike(r"^[0-9]{12,19}$|^(?:[0-9]{4}[\x20./_-]+){3}[0-9]{4}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$")
        issued = _digits(m).rlike(ISSUERS)
        gazetteer, grouping = _vote(issued, ~issued), _vote(whole, ~whole)
    else:
        digits = _digits(m)
        known = F.when(m.startswith("+"), digits.rlike(CALLING)).when(m.startswith("00"), F.substring(digits, 3, 20).rlike(CALLING)).otherwise(digits.rlike("^[2-9](?:[02-9][0-9]|1[02-9])"))
        gazetteer, grouping = _vote(known, ~known), _vote(m.rlike(r"[0-9]{3}[\x20.-][0-9]{4}$"), ~m.rlike(r"[\x20().-]"))
    votes = (_vote(passes, F.lit(strict) & ~passes), gazetteer, _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)), _vote(~edge, edge), grouping)
    features = (F.contains(m, F.lit(" ")), before.rlike(r"(?:^|\n)[^\p{L}\p{N}]*$"), F.length(_digits(m)) * 2 >= F.length(m))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(strict).alias("strict"), F.coalesce(passes, F.lit(False)).alias("base"), *[F.coalesce(v, F.lit(0)).alias(n) for n, v in zip(VOTES, votes)], *[F.coalesce(f, F.lit(False)).cast("int").alias(n) for n, f in zip(FEATURES, features)])


_CANDIDATE = "array<struct<kind:int,start:bigint,end:bigint,strict:boolean,base:boolean," + ",".join(f"{v}:int" for v in VOTES + FEATURES) + ">>"


def candidates(text: Column) -> Column:
    """All proposed spans of a text with their votes."""
    digit = text.rlike("[0-9]")
    guards = {("email", True): F.contains(text, F.lit("@")), ("ip", True): digit, ("card", True): digit, ("phone", True): F.contains(text, F.lit("+"))}
    guards |= {("email", False): text.rlike(r"(?i)[(\[]at[)\]]"), ("phone", False): text.rlike(r"[0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20.-]")}
    guards |= {("ip", False): text.rlike(r"(?i)[0-9]\x20?[(\[](?:\.|dot)[)\]]|[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]"), ("card", False): text.rlike(r"[0-9]{4}(?:[./_]|\x20[\x20-])\x20?[0-9]{4}")}
    none = F.array().cast(_CANDIDATE)
    parts = []
    for (kind, strict), guard in guards.items():
        placed = _placed(_located(text, (STRICT if strict else LOOSE)[kind]))
        parts.append(F.when(guard, F.transform(placed, _judge(kind, strict)).cast(_CANDIDATE)).otherwise(none))
    return F.concat(*parts)


def estimate(patterns: list[dict], rounds: int = 60) -> tuple[dict[int, dict[str, dict[int, float]]], list[float]]:
    """Expectation-maximisation over vote patterns (kind, strict, votes, n), each kind by itself: log odds by kind, labeler
    and vote, and the patterns' posteriors."""
    odds: dict[int, dict[str, dict[int, float]]] = {}
    post = [1 / (1 + math.exp(-sum(p[v] for v in VOTES))) for p in patterns]
    for kind in sorted({p["kind"] for p in patterns}):
        mine = [i for i, p in enumerate(patterns) if p["kind"] == kind]
        for _ in range(rounds):
            yes = 1 + sum(patterns[i]["n"] * post[i] for i in mine)
            no = 1 + sum(patterns[i]["n"] * (1 - post[i]) for i in mine)
            table = odds[kind] = {v: {} for v in VOTES}
            for v in VOTES:
                for k in (-1, 0, 1):
                    a = 1 + sum(patterns[i]["n"] * post[i] for i in mine if patterns[i][v] == k)
                    b = 1 + sum(patterns[i]["n"] * (1 - post[i]) for i in mine if patterns[i][v] == k)
                    table[v][k] = math.log(a / (yes + 2)) - math.log(b / (no + 2))
            for i in mine:
                score = math.log(yes / no) + sum(table[v][patterns[i][v]] for v in VOTES)
                post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    return odds, post


def _seen(p: dict) -> list[str]:
    """The classifier's features of a pattern."""
    return ["bias", f"kind:{p['kind']}", *["loose"] * (not p["strict"]), *[f"{v}:{p[v]}" for v in VOTES if p[v]], *[f"{p['kind']}:{v}:{p[v]}" for v in VOTES if p[v]], *[f for f in FEATURES if p[f]]]


def train(patterns: list[dict], post: list[float], rounds: int = 400, step: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """The span classifier: logistic regression on votes, votes by kind, kind, looseness and features, weighted by how often
    a pattern is seen."""
    votes = [f"{v}:{k}" for v in VOTES for k in (-1, 1)]
    names = ["bias", "loose", *votes, *[f"kind:{i}" for i in range(len(KINDS))], *[f"{i}:{v}" for i in range(len(KINDS)) for v in votes], *FEATURES]
    total = sum(p["n"] for p in patterns)
    if not total:
        return dict.fromkeys(names, 0.0) | {"bias": -30.0}
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        x[i, [at[f] for f in _seen(p)]] = 1
    n, y, w = np.array([p["n"] for p in patterns]) / total, np.array(post), np.zeros(len(names))
    for _ in range(rounds):
        z = np.clip(x @ w, -30, 30)
        w += step * (x.T @ (n * (y - 1 / (1 + np.exp(-z)))) - decay * w)
    return dict(zip(names, w.tolist()))


def _found(docs: DataFrame, columns: list[str], text: str, add_at: float) -> DataFrame:
    """row (a struct of `columns`) and spans."""
    keep = [F.col(f"`{c}`") for c in columns]
    proposed = checkpointed(docs.select(F.struct(*keep).alias("row"), candidates(F.coalesce(F.col(text), F.lit(""))).alias("c")))
    counted = proposed.select(F.explode("c").alias("x")).groupBy(*[F.col(f"x.{n}").alias(n) for n in ("kind", "strict", *VOTES, *FEATURES)]).agg(F.count("*").alias("n"))
    patterns = [r.asDict() for r in counted.sort("kind", "strict", *VOTES, *FEATURES).collect()]  # at most 4 * 2 * 3^5 * 2^3 rows
    weights = train(patterns, estimate(patterns)[1])
    chosen = F.filter("c", lambda x: x["base"] | (~x["strict"] & (_probability(x, weights) >= add_at)))
    # a loose span that overlaps a strict one says nothing new
    over = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    alone = _let(chosen, lambda c: F.when(F.exists(c, lambda x: ~x["base"]), _let(F.filter(c, lambda x: x["base"]), lambda strict: F.filter(c, lambda x: x["base"] | ~F.exists(strict, lambda y: over(x, y))))).otherwise(c))
    spans = F.array_sort(F.transform(alone, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))))
    return proposed.select("row", spans.alias("spans"))


def find_spans(docs: DataFrame, columns: list[str], text: str = "text", add_at: float = ADD_AT) -> DataFrame:
    """`columns` of docs and spans: array of (start, kind, end, base), by start and then kind as listed."""
    return _found(docs, columns, text, add_at).select("row.*", "spans")


def _probability(x: Column, weights: dict[str, float]) -> Column:
    by_kind = lambda name: F.element_at(F.array(*[F.lit(weights[name(i)]) for i in range(len(KINDS))]), x["kind"] + 1)
    z = F.lit(weights["bias"]) + by_kind(lambda i: f"kind:{i}")
    z = z + F.when(x["strict"], 0.0).otherwise(weights["loose"])
    for v in VOTES:
        for k in (-1, 1):
            z = z + F.when(x[v] == k, by_kind(lambda i: f"{i}:{v}:{k}") + weights[f"{v}:{k}"]).otherwise(0.0)  # noqa: B023
    for f in FEATURES:
        z = z + x[f] * weights[f]
    return 1 / (1 + F.exp(-z))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets (overlapping spans by one mark), and
    n_chars, where it is a column, counted anew."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("row.text")
    strings = lambda: F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(a["text"], (a["pos"] - a["from"]).cast("int") + 1, (x["start"] - a["pos"]).cast("int"))
        done = F.when(x["start"] < a["pos"], a["out"]).otherwise(F.concat(a["out"], F.array(gap, F.element_at(names, x["kind"] + 1))))
        return F.struct(F.greatest(a["pos"], x["end"]).alias("pos"), a["from"].alias("from"), a["text"].alias("text"), done.alias("out"))

    def block(acc: Column, b: Column) -> Column:
        # of the whole text a block of spans reads its own part once
        part = F.substring(text, acc["pos"].cast("int") + 1, F.greatest(F.lit(0), F.element_at(b, -1)["start"] - acc["pos"]).cast("int"))
        first = F.struct(acc["pos"].alias("pos"), acc["pos"].alias("from"), part.alias("text"), strings().alias("out"))
        return _let(F.aggregate(b, first, step), lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("spans") / BLOCK).cast("int") - 1), lambda i: F.slice("spans", i * BLOCK + 1, F.lit(BLOCK)))
    cut = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<array<string>>").alias("out")), block)
    whole = _let(cut, lambda r: F.concat(F.array_join(F.flatten(r["out"]), ""), F.substring(text, r["pos"].cast("int") + 1, F.lit(2**31 - 1))))
    row = F.col("row").withField("text", F.when(F.size("spans") > 0, whole).otherwise(text))
    redacted = _found(docs, docs.columns, "text", ADD_AT).select(row.alias("row"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("row.n_chars").isNotNull(), F.length("row.text")).cast(docs.schema["n_chars"].dataType)
        redacted = redacted.select(F.col("row").withField("n_chars", n).alias("row"))
    return redacted.select("row.*")
