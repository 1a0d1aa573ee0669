"""Functions of one row's values as column functions, for codecs that take a whole file each."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_row(f: Callable, returns: T.DataType):  # noqa: ANN201
    """A column function of `f`, which takes one row's values (null: None, binary: bytes).

    Rows come and go a hundred at a time. An Arrow function gets ten thousand, and holds all their files, those made of them and
    both as Arrow at once: its worker's memory grows with the rows of a task up to that, and with the size of a row beyond.
    """

    @wraps(f)
    def run(*values: object) -> object:
        return f(*[bytes(v) if isinstance(v, bytearray) else v for v in values])

    return F.udf(run, returns, useArrow=False)
