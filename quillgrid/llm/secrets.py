"""Secret scans with multipart credential linking.

Strict spans (assignments, access keys, long hex) always stay. Weak parts (account names and mail addresses, mixed-character
tokens, endpoints and addresses of hosts) are reported only where complementary parts stand within one scope: an interval join of identifiers,
secrets and endpoints on |distance| <= SCOPE code points inside a document, done as a sorted sweep. Parts of one kind
don't overlap, so those in scope of a secret are one run of them, found by bisection; a scope holds a bounded number of
identifiers or endpoints, so links grow with the text. Each pair of a secret and an identifier or endpoint in its scope
is in one link: the first link of a secret has the nearest of both, the second the next nearest, and so on.

Cases: null or empty text has no spans; texts of any length are read whole, with patterns that cannot go back over
more than one run of characters; null, equal or repeated doc_ids are handled row by row; equal starts are ordered by
kind as listed, equal distances prefer the part before; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCOPE = 300

#: Strict patterns. Words are looked for in lower-case text first, as few texts hold any.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Weak patterns.
IDENTIFIER = re.compile(r"(?:user_?name|user|login|client_?id|account|key_?id|access_?key)[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9_.@-]{3,})|(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.I | re.A)
IDENTIFIER_WORDS = ("user", "login", "client", "account", "keyid", "key_id", "access", "@")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]+://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<![A-Za-z0-9-])[a-z0-9-]+\.(?:amazonaws|windows|googleapis|database)\.[a-z.]{2,}"
    r"|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.]*[0-9])"
)
ENDPOINT_WORDS = ("://", ".amazonaws.", ".windows.", ".googleapis.", ".database.")
HOST = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")

SCHEMA = "spans array<struct<kind:int,start:bigint,end:bigint>>, links array<struct<identifier:struct<start:bigint,end:bigint>,secret:struct<start:bigint,end:bigint>,endpoint:struct<start:bigint,end:bigint>>>"


def _mixed(s: str) -> bool:
    return bool(re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s) and len(set(s)) >= 12)


def strict_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what is reported in any case."""
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(2, *m.span()) for m in HEX.finditer(text)]


def weak_parts(text: str, lower: str) -> tuple[list, list, list]:
    """Identifiers, secrets and endpoints that mean nothing alone, each by start."""
    names = [m.span(m.lastindex) for m in IDENTIFIER.finditer(text)] if any(w in lower for w in IDENTIFIER_WORDS) else []
    tokens = [m.span() for m in TOKEN.finditer(text) if _mixed(m[0])] if max(map(len, text.split()), default=0) >= 32 else []
    places = [m.span() for m in ENDPOINT.finditer(text)] if any(w in lower for w in ENDPOINT_WORDS) or HOST.search(text) else []
    return names, tokens, places


def _nearest(parts: list[tuple[int, int]], starts: list[int], span: tuple[int, int], scope: int) -> tuple[int, int] | None:
    i = bisect_left(starts, span[0])
    before = parts[i - 1] if i else None
    after = parts[i] if i < len(parts) else None
    gap_before = max(0, span[0] - before[1]) if before else scope + 1
    gap_after = max(0, after[0] - span[1]) if after else scope + 1
    if min(gap_before, gap_after) > scope:
        return None
    return before if gap_before <= gap_after else after


def _near(parts: list[tuple[int, int]], starts: list[int], stops: list[int], span: tuple[int, int], scope: int) -> list[tuple[int, int]]:
    """All parts within scope, the nearest first; starts and stops must both be sorted."""
    first = _nearest(parts, starts, span, scope)
    if first is None:
        return []
    run = parts[bisect_left(stops, span[0] - scope) : bisect_right(starts, span[1] + scope)]
    gap = lambda x: max(0, x[0] - span[1]) if x[0] >= span[0] else max(0, span[0] - x[1])
    return [first, *sorted((x for x in run if x != first), key=lambda x: (gap(x), x[0] >= span[0], x))]


def scan(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """All spans by start, then kind; and for each linked secret its identifiers and endpoints, paired by nearness (None
    where one kind has fewer)."""
    text = text or ""
    lower = text.lower()
    strict = strict_spans(text, lower)
    names, tokens, places = weak_parts(text, lower)
    if not strict and not (tokens and (names or places)):
        return [], []
    taken = sorted((s, e) for _, s, e in strict)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(span: tuple[int, int]) -> bool:
        i = bisect_left(starts, span[1])
        return not i or furthest[i - 1] <= span[0]

    ids = sorted({(s, e) for k, s, e in strict if k == 1} | {x for x in names if free(x)})
    secrets = sorted({(s, e) for k, s, e in strict if k != 1} | {x for x in tokens if free(x)})
    ends = sorted(set(places))
    id_at, end_at = [[x[i] for x in ids] for i in (0, 1)], [[x[i] for x in ends] for i in (0, 1)]
    links, used = [], set()
    for secret in secrets:
        for who, where in zip_longest(_near(ids, *id_at, secret, scope), _near(ends, *end_at, secret, scope)):
            links.append((who, secret, where))
            used |= {(3, who), (4, secret), (5, where)}
    strict_set = {(s, e) for _, s, e in strict}
    weak = [(k, *x) for k, x in used if x and x not in strict_set]
    return sorted(strict + weak, key=lambda x: (x[1], x[0], x[2])), links


def find_secrets(docs: DataFrame, columns: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """`columns` of docs, spans (kind as an index of KINDS, start, end) and links; no shuffle."""
    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"))
    made = StructType.fromDDL(SCHEMA)
    schema = StructType([chosen.schema["row"], *made.fields])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = (pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("identifier", span), ("secret", span), ("endpoint", span)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda x: x and {"start": x[0], "end": x[1]}
        for batch in batches:
            spans, links = [], []
            for x in batch.column(1):
                found, linked = scan(x.as_py(), scope)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                links.append([{"identifier": part(a), "secret": part(b), "endpoint": part(c)} for a, b, c in linked])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, types[0]), pa.array(links, types[1])], names=schema.names)

    return chosen.mapInArrow(run, schema).select("row.*", *made.names)
