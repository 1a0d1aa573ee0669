"""Finite-state checks over ordered rows, folded in parts: what a stretch of rows does to each state is a map, and maps compose.

So a key's rows need not be in one task or group: rows are folded by blocks of BLOCK places, blocks by blocks of blocks, each group
having at most BLOCK members.

Cases: a null symbol, and one that the table lacks, leads to the table's last state, as nothing is known of it; a key without
rows has no result; rows of a key with one number are in the order of their symbols; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


@dataclass(frozen=True)
class Automaton:
    """states: names, the first is where all begin and the last where unknown symbols lead; moves: for each symbol the state
    that each state goes to."""

    states: tuple[str, ...]
    moves: dict[str, dict[str, str]]

    def table(self) -> dict[str, list[int]]:
        """For each symbol the numbers of the states that the states go to; a state without a move stays."""
        return {symbol: [self.states.index(to.get(s, s)) for s in self.states] for symbol, to in self.moves.items()}

    def step(self, symbol: str | None, state: str) -> str:
        return self.moves[symbol].get(state, state) if symbol in self.moves else self.states[-1]


def _composed(maps: Column, size: int) -> Column:
    """What a list of maps (arrays of state numbers) does one after the other."""
    identity = F.array(*[F.lit(i) for i in range(size)])
    return F.aggregate(maps, identity, lambda done, m: F.transform(done, lambda s: F.get(m, s)))


def ends(rows: DataFrame, key: str, place: str, symbol: str, automaton: Automaton) -> DataFrame:
    """(key, state, n): the state that each key's rows, in the order of `place` (0, 1, ...), lead to, and how many there are."""
    size, table = len(automaton.states), automaton.table()
    lost = F.array(*[F.lit(size - 1)] * size)
    number = F.create_map(*[x for i, s in enumerate(table) for x in (F.lit(s), F.lit(i))])
    held = F.array(*[F.array(*map(F.lit, to)) for to in table.values()], lost)
    at = F.coalesce(F.try_element_at(number, F.col(symbol)), F.lit(len(table)))
    level = rows.select(key, F.col(place).cast("long").alias("_at"), at.alias("_s"))
    first = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_s"))), lambda x: F.get(held, x["_s"]))
    level = level.groupBy(key, F.floor(F.col("_at") / BLOCK).alias("_at")).agg(_composed(first, size).alias("_m"), F.count("*").alias("n"))
    for _ in range(3):
        parts = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"])
        level = level.groupBy(key, F.floor(F.col("_at") / BLOCK).alias("_at")).agg(_composed(parts, size).alias("_m"), F.sum("n").alias("n"))
    names = F.array(*map(F.lit, automaton.states))
    return level.select(key, F.get(names, F.get("_m", 0)).alias("state"), "n")


def _png() -> Automaton:
    """The order of a picture's chunks, with a record and a payload that files inside pictures have."""
    good = ("begin", "head", "pixels", "record", "payload", "picture", "package")
    bad = ("header", "animated", "order", "record wrong", "payload wrong", "extra", "ending", "unknown")
    after = {s: "extra" for s in ("picture", "package")}
    all_ = lambda to: {s: to for s in good}
    start = {"begin": "header"}
    moves = {
        "IHDR": all_("header") | {"begin": "head"},
        "IDAT": after | start | {"head": "pixels", "payload": "order"},
        "aiMd": after | start | {"head": "record wrong", "pixels": "record", "record": "record wrong", "payload": "record wrong"},
        "aiPd": after | start | {"head": "payload wrong", "pixels": "payload wrong", "record": "payload", "payload": "payload wrong"},
        "IEND": after | start | {"head": "ending", "pixels": "picture", "record": "ending", "payload": "package"},
        "other": after | start | {"payload": "extra"},
    }
    moves |= dict.fromkeys(("acTL", "fcTL", "fdAT"), all_("animated") | start)
    return Automaton((*good, *bad), moves)


PNG_ORDER = _png()


def kind_of(chunk: Column) -> Column:
    """A chunk's symbol in PNG_ORDER."""
    named = [s for s in PNG_ORDER.moves if s != "other"]
    return F.when(chunk.isin(*named), chunk).when(chunk.rlike("^[A-Za-z]{2}[A-Z][A-Za-z]$"), "other")
