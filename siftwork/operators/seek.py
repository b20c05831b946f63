"""Where the patterns of the recognizers match, found in Arrow tasks: texts go through each pattern's hint, then those that hold it through the pattern. What a match is worth is told in columns (recognize).

Matches are those of the columns' own search: leftmost, without overlaps, offsets in code points. Names in front of an @ are looked for from the @ backwards, so that a run of name characters is gone through once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.functions.text import NEAR

_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_NAME, _PAYEE = _WORD | frozenset(".!#$%&'*+/=?^`{|}~-"), _WORD | frozenset(".-")
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_HOST = re.compile(rf"{_LABEL}(?:\.{_LABEL}){{0,125}}\.(?:{schema.TLDS})\b", re.ASCII)
_HANDLE = re.compile(r"[a-zA-Z]{2,64}\b", re.ASCII)
_RUNS = re.compile("[A-Za-z0-9_-]{19,}")
_SECRET = re.compile(r"(?:sk|pk|api|token|secret|key)_[A-Za-z0-9_-]{16,}|[A-Za-z0-9_-]{24,}")
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("lead", pa.string()), ("trail", pa.string())])
#: Kinds whose matches hold a digit: a text without any is spared their hints.
_DIGITS = frozenset("phone_in_e164 phone_in_bare phone_generic aadhaar pan ifsc gstin card ipv4 dob_iso dob_us".split())
_DIGIT = re.compile("[0-9]").search
Span = tuple[int, int]


def _run(text: str, low: int, at: int, among: frozenset) -> int:
    """Where the run of characters that ends at `at` begins, not before low."""
    while at > low and text[at - 1] in among:
        at -= 1
    return at


def _edge(text: str, low: int, high: int) -> int | None:
    """The first edge of a word in low..high."""
    for i in range(low, high + 1):
        if (text[i] in _WORD) != (i > 0 and text[i - 1] in _WORD):
            return i
    return None


def _by_at(among: frozenset, least: int, most: int | None, tail: re.Pattern) -> Callable[[str], Iterator[Span]]:
    """Matches of an edge, least to most characters of a class, @ and a tail."""

    def find(text: str) -> Iterator[Span]:
        end, at = 0, text.find("@")
        while at >= 0:
            m = tail.match(text, at + 1)
            if m:
                start = _edge(text, _run(text, end if most is None else max(end, at - most), at, among), at - least)
                if start is not None:
                    end = m.end()
                    yield start, end
            at = text.find("@", at + 1)

    return find


def _by_pattern(pattern: str) -> Callable[[str], Iterator[Span]]:
    # an edge in front of a class of word characters is tested behind it, where few places are left
    head = re.match(r"\\b(\[[^\]]+\])(?:\{(\d+)\})?(?![?*+{])", pattern)
    if head:
        cls, n = head[1], int(head[2] or 1)
        pattern = rf"{cls}(?<!\w\w)" + (f"{cls}{{{n - 1}}}" if n > 1 else "") + pattern[head.end():]
    # a look-behind has one width here
    compiled = re.compile(re.sub(r"^\(\?<=\^\|(\[.*?[^\\]\])\)", lambda m: f"(?:^|(?<={m[1]}))", pattern), re.ASCII)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _secrets(text: str) -> Iterator[Span]:
    return (m.span() for m in _RUNS.finditer(text) if _SECRET.fullmatch(m[0]))


_FINDERS = {n: _by_pattern(p) for n, p in schema.PATTERNS.items()} | {"email": _by_at(_NAME, 1, None, _HOST), "upi": _by_at(_PAYEE, 2, 256, _HANDLE), "secret": _secrets}


def spans_of(name: str, text: str) -> list[dict]:
    return [{"start": s, "end": e, "value": text[s:e], "lead": text[max(0, s - NEAR):s], "trail": text[e:e + NEAR]} for s, e in _FINDERS[name](text)]


def seek(text: Column, hints: dict[str, str]) -> Column:
    """struct of array<struct<start, end, value, lead, trail>>, a field for each recognizer of hints, a literal or a pattern that a text must hold; null where nothing is found. Null texts count as empty. A text that stands several times in a batch is looked through once."""
    kinds = list(hints)
    plain = [n for n in kinds if n not in _DIGITS]
    result = ", ".join(f"{n}: array<struct<start: int, end: int, value: string, lead: string, trail: string>>" for n in kinds)
    holds = {n: (lambda t, h=h: h in t) if h in ("@", "::", "+91") else re.compile(h).search for n, h in hints.items()}

    @F.arrow_udf(f"struct<{result}>")
    def found(texts: pa.Array) -> pa.Array:
        # bytes that are no text must not fail a task
        rows = [b"" if b is None else b for b in texts.cast(pa.binary()).to_pylist()]
        rows = [b.decode("utf-8", "replace") for b in rows]
        lots, nth = [], {}
        for t in dict.fromkeys(rows):
            some = {n: spans_of(n, t) for n in (kinds if _DIGIT(t) else plain) if holds[n](t)}
            nth[t] = len(lots) if any(some.values()) else None
            if nth[t] is not None:
                lots.append(some)
        every = pa.StructArray.from_arrays([pa.array([some.get(n, []) for some in lots], pa.list_(_SPAN)) for n in kinds], kinds)
        return every.take(pa.array([nth[t] for t in rows], pa.int32()))

    return found(text)
