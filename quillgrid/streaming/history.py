"""Undo and redo as folds: rows of one key in order, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_STATES, MOST_BYTES = 50, 256 * 1024 * 1024


@dataclass
class History:
    """Two stacks of (id, bytes). Beyond the limits the oldest goes, of undo first, but never a stack's last one."""

    undo: list[tuple[int, int]] = field(default_factory=list)
    redo: list[tuple[int, int]] = field(default_factory=list)

    def apply(self, action: str, state: tuple[int, int]) -> int | None:
        """Push a state, or go back (undo) or forth (redo) while `state` is shown; the id of what then appears."""
        if action == "push":
            self.redo.clear()
            self.undo.append(state)
            shown = None
        elif action == "clear":
            self.undo.clear()
            self.redo.clear()
            return None
        else:
            out, into = (self.redo, self.undo) if action == "redo" else (self.undo, self.redo)
            if not out:
                return None
            shown = out.pop()[0]
            into.append(state)
        while len(self.undo) + len(self.redo) > MOST_STATES or sum(n for _, n in self.undo + self.redo) > MOST_BYTES:
            full = next((s for s in (self.undo, self.redo) if len(s) > 1), None)
            if full is None:
                break
            full.pop(0)
        return shown


def replayed(actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, id, shown, undo, redo) after each row of (`key`, id, action, bytes), rows in `order` within a key. A task holds one batch
    of rows and one history at a time, however long a key's history is."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, history = None, History()
        for part in parts:
            rows = []
            for k, i, action, n in zip(part[key], part["id"], part["action"], part["bytes"]):
                if k != now:
                    now, history = k, History()
                shown = history.apply(action, (i, n))
                rows.append((k, i, shown, len(history.undo), len(history.redo)))
            yield pd.DataFrame(rows, columns=[key, "id", "shown", "undo", "redo"]).astype({"shown": "Int64"})

    kind = dict(actions.dtypes)
    laid = actions.repartition(key).sortWithinPartitions(key, *order).select(key, "id", "action", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return laid.mapInPandas(walk, f"{key} {kind[key]}, id {kind['id']}, shown {kind['id']}, undo int, redo int")


def active(events: DataFrame, key: str, phase: str, finished: tuple[str, ...], order: list[str]) -> DataFrame:
    """The latest event of each key whose last phase is none of the finished ones."""
    last = events.groupBy(key).agg(F.max(F.struct(*order, phase)).alias("last"))
    return last.where(~F.col(f"last.{phase}").isin(*finished)).select(key, *[F.col(f"last.{c}").alias(c) for c in (*order, phase)])
