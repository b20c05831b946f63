"""Recognizers: text column -> array of spans.

Matches are the leftmost that don't overlap; tests that follow drop whole matches and never look again inside one. Null texts
have no spans, empty ones none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.functions import checks
from siftwork.functions.text import after, before, let, spans

from .seek import seek

#: Year up to which a birth date counts, less 13: a parameter instead of the clock, so that reruns agree.
AS_OF = 2026


class Seen(NamedTuple):
    """Where a recognizer's pattern matches, in place of the text."""

    spans: Column


def _found(text: Column | Seen, name: str, keep, kind: str, rule, confidence, find=None) -> Column:
    """Spans of a pattern, or of find(text), that keep(span) accepts, with type, tier, confidence and rule."""
    find = find or (lambda t: spans(t, schema.PATTERNS[name], near=True))
    matches = text.spans if isinstance(text, Seen) else find(F.coalesce(text, F.lit("")))
    as_col = lambda x, s: x(s) if callable(x) else F.lit(x)
    made = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("type"), F.lit(schema.TIERS[kind]).alias("tier"), as_col(confidence, s).cast("double").alias("confidence"), as_col(rule, s).alias("rule_id"))
    return let(matches, lambda all_: F.transform(F.filter(all_, keep), made))


def _apart(cls: str):
    """No character of cls on either side."""
    return lambda s: ~before(s).rlike(cls) & ~after(s).rlike(cls)


def _around(s: Column, n: int) -> Column:
    return F.lower(F.concat(before(s, n), after(s, n)))


_NAME, _NO_WORD = r"a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-", r".!#$%&'*+/=?^`{|}~-"
#: The mail pattern for Java's engine, which takes the same time for each character: a run of name characters is gone through once, from its beginning or behind the match
#: before it, and a host has at most 127 labels, as hosts do, since a group without bounds exhausts the engine's stack.
MAIL = (
    rf"(?:(?<![{_NAME}])(?=[{_NO_WORD}]*+[a-zA-Z0-9_])|(?<=[a-zA-Z0-9_])\G)[{_NAME}]++@[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?){{0,125}}\.(?:"
    + schema.TLDS + r")\b"
)


def _mails(text: Column) -> Column:
    """Spans of the mail pattern, which begin at a word's edge."""
    lead = lambda s: F.when(before(s).rlike("[a-zA-Z0-9_]"), 0).otherwise(F.length(F.regexp_extract(s["value"], f"^[{_NO_WORD}]+", 0)))
    cut = lambda s, n: s.withField("start", s["start"] + n).withField("value", s["value"].substr(n + 1, F.length(s["value"])))
    return F.transform(spans(text, MAIL, near=True), lambda s: let(lead(s), lambda n: F.when(n == 0, s).otherwise(cut(s, n))))


def email(text: Column) -> Column:
    return _found(text, "email", lambda s: ~s["value"].rlike("(?i)" + schema.RESERVED_MAIL), "EMAIL", "email-regex-v1", 0.95, _mails)


def phone_in_e164(text: Column) -> Column:
    # the digits are exactly ten, so that a digit behind them drops the match
    return _found(text, "phone_in_e164", lambda s: ~before(s).rlike("[0-9+]") & ~after(s).rlike("[0-9]"), "PHONE", "phone-e164-indian-v1", 0.98)


def _phone_context(s: Column) -> Column:
    """Twenty characters before and twenty from the number's first on."""
    return F.lower(F.concat(before(s, 20), F.left(F.concat(s["value"], s["trail"]), F.lit(20)))).rlike(schema.PHONE_CONTEXT)


def phone_in_bare(text: Column) -> Column:
    by_context = lambda near, bare: lambda s: F.when(_phone_context(s), near).otherwise(bare)
    return _found(text, "phone_in_bare", lambda s: ~before(s).rlike("[0-9+]") & ~after(s).rlike("[0-9]"), "PHONE", by_context("phone-indian-v1", "phone-indian-bare-v1"), by_context(0.9, 0.7))


def phone_generic(text: Column) -> Column:
    return _found(text, "phone_generic", lambda s: ~s["value"].startswith("+91") & ~before(s).rlike("[0-9+]") & ~after(s).rlike("[0-9]"), "PHONE", "phone-e164-generic-v1", 0.85)


def aadhaar(text: Column) -> Column:
    ok = lambda s: _apart("[0-9]")(s) & checks.verhoeff_ok(F.regexp_replace(s["value"], "[ -]", ""))
    return _found(text, "aadhaar", ok, "AADHAAR", "aadhaar-verhoeff-v1", 0.99)


def pan(text: Column) -> Column:
    ok = lambda s: _apart("[A-Z0-9]")(s) & ~s["value"].startswith("PRODU") & ~s["value"].rlike("^[A-Z]{5}0{4}[A-Z]$")
    return _found(text, "pan", ok, "PAN", "pan-regex-v1", 0.95)


def ifsc(text: Column) -> Column:
    ok = lambda s: _apart("[A-Z0-9]")(s) & F.substring(s["value"], 1, 4).isin(*schema.BANK_CODES)
    return _found(text, "ifsc", ok, "IFSC", "ifsc-regex-v1", 0.95)


def gstin(text: Column) -> Column:
    ok = lambda s: _apart("[A-Z0-9]")(s) & (checks.gstin_char(F.substring(s["value"], 1, 14)) == F.substring(s["value"], 15, 1))
    return _found(text, "gstin", ok, "GSTIN", "gstin-checkchar-v1", 0.99)


def upi(text: Column) -> Column:
    ok = lambda s: _apart(r"[a-zA-Z0-9.\-_@]")(s) & (F.length(F.substring_index(s["value"], "@", 1)) >= 3) & F.lower(F.substring_index(s["value"], "@", -1)).isin(*schema.UPI_HANDLES)
    return _found(text, "upi", ok, "UPI", "upi-vpa-v1", 0.9)


def card(text: Column) -> Column:
    digits = lambda s: F.regexp_replace(s["value"], "[ -]", "")
    ok = lambda s: _apart("[0-9]")(s) & ~(s["value"].contains(" ") & s["value"].contains("-")) & ~digits(s).isin(*schema.SAMPLE_CARDS) & checks.luhn_ok(digits(s)) & ~_around(s, 30).rlike(schema.CARD_CONTEXT)
    return _found(text, "card", ok, "CARD", "card-luhn-v1", 0.98)


def ipv4(text: Column) -> Column:
    return _found(text, "ipv4", _apart("[0-9.]"), "IP", "ip-v4-v1", 0.9)


def ipv6_full(text: Column) -> Column:
    return _found(text, "ipv6_full", _apart("[:0-9a-fA-F]"), "IP", "ip-v6-v1", 0.85)


def ipv6_compressed(text: Column) -> Column:
    return _found(text, "ipv6_compressed", lambda s: F.lit(True), "IP", "ip-v6-compressed-v1", 0.8)


def _birth(y: Column, m: Column, d: Column, as_of: int) -> Column:
    last = F.when(m == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return m.between(1, 12) & d.between(1, last) & y.between(1900, as_of - 13)


def _dob(text: Column, name: str, rule: str, confidence: float, as_of: int) -> Column:
    def ok(s: Column) -> Column:
        p = lambda i: F.get(F.split(s["value"], "[-/.]"), i).cast("int")
        valid = F.when((p(0) > 12) & (p(1) <= 12), _birth(p(0), p(1), p(2), as_of)).when((p(0) <= 12) & (p(1) > 12), _birth(p(2), p(0), p(1), as_of)).otherwise(False)
        return _apart(r"[0-9\-./]")(s) & valid & _around(s, 30).rlike(schema.DOB_CONTEXT)

    return _found(text, name, ok, "DOB", rule, confidence)


def dob_iso(text: Column, as_of: int = AS_OF) -> Column:
    return _dob(text, "dob_iso", "dob-iso-v1", 0.9, as_of)


def dob_us(text: Column, as_of: int = AS_OF) -> Column:
    """Dates whose day is over 12; others can't be told from day-first ones and are left out."""
    return _dob(text, "dob_us", "dob-us-v1", 0.85, as_of)


def secret(text: Column) -> Column:
    """Our own rule: a prefixed key, or a token of 24 or more characters with over four bits a character; demo ones are left out."""
    edge = "[A-Za-z0-9_-]"
    find = lambda t: spans(t, rf"(?<!{edge})(?:(?:sk|pk|api|token|secret|key)_[A-Za-z0-9_-]{{16,}}|{edge}{{24,}})(?!{edge})")
    keep = lambda s: ~s["value"].startswith("demo") & (s["value"].rlike("^(sk|pk|api|token|secret|key)_[A-Za-z0-9_-]{16,}$") | (checks.shannon(s["value"]) > schema.ENTROPY_BITS))
    return _found(text, "secret", keep, "SECRET", "secret-entropy-v1", 0.9, find)


#: In the order in which results are listed.
RECOGNIZERS = {f.__name__: f for f in (email, phone_in_e164, phone_in_bare, phone_generic, aadhaar, pan, ifsc, gstin, upi, card, ipv4, ipv6_full, ipv6_compressed, dob_iso, dob_us, secret)}
#: What a text must hold for a recognizer to find anything: a cheap test in front of the patterns.
HINTS = {
    "email": "@", "upi": "@", "pan": "[A-Z]{5}[0-9]", "ifsc": "[A-Z]{4}0", "secret": "[A-Za-z0-9_-]{19}", "ipv6_full": ":[0-9a-fA-F]+:", "ipv6_compressed": "::",
    "phone_in_e164": "+91", "phone_in_bare": "[6-9][0-9]{9}", "phone_generic": r"\+[0-9]", "aadhaar": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "gstin": "[0-9]{2}[A-Z]{5}[0-9]",
    "card": "[0-9](?:[ -]?[0-9]){12}", "ipv4": r"[0-9]\.[0-9]{1,3}\.[0-9]", "dob_iso": "(?:19|20)[0-9]{2}[-/.][01]", "dob_us": "[0-9]{2}[-/.](?:19|20)[0-9]{2}",
}


SPANS = "array<struct<start:int,end:int,value:string,type:string,tier:int,confidence:double,rule_id:string>>"


def _hinted(text: Column, name: str) -> Column:
    hint = HINTS[name]
    return F.contains(text, F.lit(hint)) if hint in ("@", "::", "+91") else text.rlike(hint)


def recognize(text: Column, names=tuple(RECOGNIZERS)) -> Column:
    """All spans of the named recognizers, one after another; overlaps stay. Matches are found in Arrow tasks, in one go over the text for all names."""
    found = seek(text, {n: HINTS[n] for n in names})
    none = F.array().cast(SPANS)
    return F.when(found.isNull(), none).otherwise(F.concat(none, *[RECOGNIZERS[n](Seen(found[n])) for n in names]))


def detect(rows: DataFrame, key: str, text_col: str, names=tuple(RECOGNIZERS)) -> DataFrame:
    """(key, nth, start, end, value, type, tier, confidence, rule_id): a row for each span, in order."""
    found = rows.select(F.col(key), F.posexplode(recognize(F.col(text_col), names)).alias("nth", "s"))
    return found.select(key, F.col("nth").cast("long").alias("nth"), "s.*")


def by_type(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, type, n, first_start): the spans of each text by type, types without spans left out."""
    return detect(rows, key, text_col).groupBy(key, "type").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))
