"""Secret scan with multipart credential linking.

Base spans (assign, access, hex) are always reported. Weak candidates are parts that prove nothing alone: a login name or
key identifier (ident), a short or high-entropy value (part) and an address (endpoint). An interval join over each scope
reports a weak one only where a complementary part, which doesn't overlap it, lies in the same scope, however far away:

* ident     with any secret part: assign, hex or part
* part      with any identifier: access or ident
* endpoint  with an identifier and a secret part that don't overlap one another

A scope is a stretch of text between blank lines. Weak candidates that overlap a base span are part of it, endpoints excepted. Spans that begin
together come in the order of their kinds. Null texts count as empty; very long texts are scanned whole, one at a time, and links take time in
proportion to the candidates. Rows are independent: repeated rows give repeated results, an empty table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, spread

#: Fixed patterns. Letters of the keywords stand in either case, ASCII only.
_KEYWORDS = ("password", "passwd", "secret", "token")
_EITHER = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
ASSIGN = re.compile(rf"""({"|".join(map(_EITHER, _KEYWORDS))}|{_EITHER("api")}_?{_EITHER("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 16 or more is what [0-9a-f]+ finds and the length test keeps.
HEX = re.compile(r"[0-9a-f]{16,}")
IDENT = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|ftp|sftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
KINDS = ("assign", "access", "hex", "ident", "part", "endpoint")
ENTROPY = 3.5
_BLANK = re.compile(r"\n[ \t\r]*\n")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kinds by their place in KINDS."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    out = []
    pair = "=" in text or ":" in text
    if pair:
        out += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
        out += [(m.start(), 4, m.end()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < 12]
        if "://" in text:
            out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    for m in TOKEN.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and entropy(s) > ENTROPY:
            out.append((m.start(), 4, m.end()))
    return out


class _Side:
    """The identifiers or secrets of a scope: is one of them clear of an interval, and how early do such end, how late do they begin?"""

    def __init__(self, spans: list[tuple[int, int]]):
        self.by_start, self.by_end = sorted(spans), sorted(spans, key=lambda x: x[1])
        self.starts, self.ends = [s for s, _ in self.by_start], [e for _, e in self.by_end]
        #: The least end among those from each place on by start, the largest start among those up to each place by end.
        self.least = list(itertools.accumulate((e for _, e in reversed(self.by_start)), min))[::-1]
        self.most = list(itertools.accumulate((s for s, _ in self.by_end), max))

    def clear_of(self, lo: int, hi: int) -> tuple[int, int] | None:
        """(least end, largest start) of those that don't overlap [lo, hi)."""
        before, after = bisect.bisect_right(self.ends, lo), bisect.bisect_left(self.starts, hi)
        if not before and after == len(self.starts):
            return None
        return self.ends[0] if before else self.least[after], self.starts[-1] if after < len(self.starts) else self.most[before - 1]


def link(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts whose complement lies in their scope, clear of them: an interval join on sorted ends, linear but for the look-ups."""
    taken = _Side([(s, e) for s, _, e in base])
    overlaps = lambda s, e: bisect.bisect_left(taken.starts, e) > bisect.bisect_right(taken.ends, s)
    weak = [w for w in weak if w[1] == 5 or not overlaps(w[0], w[2])]
    if not weak:
        return []
    walls = [m.start() for m in _BLANK.finditer(text)]
    scope = lambda span: bisect.bisect_right(walls, span[0])
    out = []
    every = sorted({*base, *weak})
    for _, spans in itertools.groupby(every, scope):
        spans = list(spans)
        secret, ident = (_Side([(s, e) for s, k, e in spans if k in kinds]) for kinds in ((0, 2, 4), (1, 3)))
        for s, k, e in spans:
            if k == 3 and secret.clear_of(s, e) or k == 4 and ident.clear_of(s, e):
                out.append((s, k, e))
            elif k == 5 and (a := secret.clear_of(s, e)) and (b := ident.clear_of(s, e)) and (a[0] <= b[1] or b[0] <= a[1]):
                out.append((s, k, e))
    return out


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    weak = weak_parts(text)
    return base, sorted({*base, *link(text, base, weak)}) if weak else base


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base string, spans string): comma-joined kind:start:end by start, then kind; code points, end exclusive."""

    def run(batches):
        for batch in small(batches):
            found = [spans_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_said(b) for b, _ in found], pa.string()), pa.array([_said(a) for _, a in found], pa.string())], names=[id_col, "base", "spans"])

    rows = spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, base string, spans string")


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter(F.split("base", ","), lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, *map(count, KINDS[:3]), F.sha2("base", 256).alias("base_sha256"), "spans")
