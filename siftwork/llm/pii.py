"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

Found values are permuted within their format under a key: a value becomes another value of the same format, equal values
become equal ones in every document, different ones stay different. The kinds and what makes a value valid:

* email    local@domain; letters and digits of the local part are permuted within their classes, the domain stays and is part of the tweak
* card     13 to 19 digits, single spaces or dashes between (they don't change the pseudonym); passes Luhn; the check digit is computed anew
* iban     country, two check digits, up to 30 letters and digits; passes mod 97; check digits are computed anew
* ssn      AAA-GG-SSSS with a valid area, group and serial; walks the cycle until valid again
* phone    + and 8 to 15 digits, or (AAA) BBB-CCCC or AAA-BBB-CCCC; digits behind the country code are permuted
* ipv4     four numbers up to 255 without leading zeros; each keeps its number of digits
* date     YYYY-MM-DD, YYYY/MM/DD, YYYY.MM.DD, DD.MM.YYYY and MM/DD/YYYY of the calendar; permuted within its 400 years
           (a calendar cycle of 146097 = 189 * 773 days, so that the two halves fit exactly)

Invalid values stay as they are. Where a match is not valid, or is a number of unusual groups that may hold a neighbour's digits,
its line is looked through again from group to group (see `_lines` and `_gaps`), so that a valid number beside other digits or capitals is
found. Null texts stay null, empty ones empty. Rows are independent and equal rows get equal results; where two values could begin at the same place, the
kind that stands first above is taken. A very long text is handled whole, as an array of its pieces; a host has at most 127 labels, and no pattern repeats a
group without bounds, so that no text exhausts the pattern engine's stack. Extra columns pass through, a column with the name of the result is replaced.

The network has ROUNDS rounds (SMALL_ROUNDS for up to three characters) whose function is SHA-256 in counter mode over key, kind,
format, round, half and the other half, so that no two places share hash bits. A single character is split into two coordinates,
which are permuted in turn, so it isn't only shifted. The key enters the plan as a row of its own and shows in no explain output;
where none is passed, the session's setting KEY_SETTING gives it, whose name Spark redacts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, spread

ROUNDS, SMALL_ROUNDS = 8, 24
KEY_SETTING = "spark.siftwork.pii.secret"
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")

_N, _W = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
#: Fixed patterns, in order of precedence where two begin at the same place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rf"{_N}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}{_W}",
    "date": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}){_W}",
    "ssn": rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])",
    "phone": rf"(?<![0-9A-Za-z+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){{5,13}}{_W}|(?<![0-9A-Za-z])\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}{_W}|(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}(?![0-9A-Za-z-])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": rf"{_N}[0-9](?:[ -]?[0-9]){{12,18}}{_W}",
}
ANY = "|".join(PATTERNS.values())
#: Cheap test that keeps texts without digits and @ from the patterns.
HINT = r"[0-9@]"
DAYS = (189, 773)
#: How cards are mostly written: groups of 4-4-4-4, 4-6-5 or 4-6-4, or none. Other groups count only where these don't.
SHAPES = r"[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5}|[2-6][0-9]{12,18}"
#: Lengths of IBANs by country.
LENGTHS = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
#: Matches begin and end between atoms. The longest number has fewer than WINDOW of them; a mail address, of 64 characters, 126 labels of 63 and
#: a last one, fewer than MAIL_WINDOW, which is taken only where what begins a mail address stands in front.
ATOM, WINDOW, MAIL_WINDOW = "(?s)[0-9A-Za-z]+|[^0-9A-Za-z]", 200, 8300
MAIL_BEGINS = r"(?s)^[^A-Za-z0-9._%+-][A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9]"
#: More digits behind + than a phone number has: its pattern may take some of a neighbour's.
CROWDED = r"\+[0-9](?:[ .()-]{0,3}[0-9]){15}"


def feistel(values: Column, radix: Column, half: Column, key: Column, tweak: str, rounds: Column | int = ROUNDS) -> Column:
    """A keyed permutation of the arrays of numbers with values[i] < radix[i]: in turn each half is shifted by a hash of the other. All arguments must be columns or lambda variables already bound."""
    text = lambda x: x.cast("string")

    def one(state: Column, r: Column) -> Column:
        left = F.pmod(r, F.lit(2)) == 0
        other = F.when(left, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, F.lit(1), half))
        seed = F.concat_ws("|", key, F.lit(tweak), text(r), F.array_join(F.transform(other, text), ","))

        def shifted(seed: Column) -> Column:
            # each digest of 64 hexadecimal digits serves ten places
            digests = F.transform(F.sequence(F.lit(0), F.floor((F.size(state) - 1) / 10).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, text(k)), 256))
            part = lambda d, i: F.conv(F.get(d, F.floor(i / 10).cast("int")).substr((F.pmod(i, F.lit(10)) * 6 + 1).cast("int"), F.lit(6)), 16, 10).cast("long")
            return let(digests, lambda d: F.transform(state, lambda v, i: F.when((i < half) == left, F.pmod(v + part(d, i), F.get(radix, i))).otherwise(v)))

        return let(seed, shifted)

    count = F.lit(rounds) if isinstance(rounds, int) else rounds
    return F.aggregate(F.sequence(F.lit(0), count - 1), values, one)


def _class(c: Column, digit, lower, upper) -> Column:
    return F.when(c <= "9", digit).when(c >= "a", lower).otherwise(upper)


def permute_chars(text: Column, fixed: Column, key: Column, tweak: str) -> Column:
    """text with its ASCII digits and letters permuted within their classes, but for the first `fixed` characters; text and fixed must be bound."""

    def of(tail: Column) -> Column:
        chars = F.split(_flat(tail), "")
        radix = F.transform(chars, lambda c: _class(c, 10, 26, 26).cast("long"))
        values = F.transform(chars, lambda c: (F.ascii(c) - _class(c, 48, 97, 65)).cast("long"))
        # the shape and the fixed part are part of the tweak, so that formats are permuted apart
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
        about = F.concat_ws("|", key, F.concat(text.substr(F.lit(1), fixed), shape))

        def back(s: Column, cs: Column) -> Column:
            flat = F.array_join(F.transform(cs, lambda c, i: F.char(F.get(s, i) + _class(c, 48, 97, 65))), "")
            return let(flat, lambda f: _as_written(tail, f))

        def run(cs: Column, rx: Column, vs: Column, key: Column) -> Column:
            half, rounds = F.floor((F.size(cs) + 1) / 2).cast("int"), F.when(F.size(cs) <= 3, SMALL_ROUNDS).otherwise(ROUNDS)
            many = let(half, lambda hf: let(rounds, lambda n: feistel(vs, rx, hf, key, tweak, n)))
            # one character: its number is parted into a bit and the rest
            wide = F.floor(F.get(rx, 0) / 2).cast("long")
            two = lambda w: let(F.array(F.lit(2).cast("long"), w), lambda rx2: let(F.array(F.floor(F.get(vs, 0) / w).cast("long"), F.pmod(F.get(vs, 0), w)), lambda v2: feistel(v2, rx2, F.lit(1), key, tweak, SMALL_ROUNDS)))
            one = let(wide, lambda w: let(two(w), lambda s: F.array(F.get(s, 0) * w + F.get(s, 1))))
            return let(F.when(F.size(cs) == 1, one).otherwise(many), lambda s: back(s, cs))

        made = let(chars, lambda cs: let(radix, lambda rx: let(values, lambda vs: let(about, lambda k: run(cs, rx, vs, k)))))
        return F.when(_flat(tail) == "", text).otherwise(F.concat(text.substr(F.lit(1), fixed), made))

    return let(text.substr(fixed + 1, F.length(text)), of)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit for a string of digits (bound)."""
    digits = F.transform(F.reverse(F.split(payload, "")), lambda c, i: let(c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(digits, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """A string of digits and upper-case letters, read as in IBANs, modulo 97."""
    number = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c <= "9", 10).otherwise(100) + number(c), F.lit(97)).cast("int"))


def _walk(first: Column, step, valid, most: int = 64) -> Column:
    """step(step(...first)) until valid: a permutation of the valid values, as that of a cycle restricted to them."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), step(first), lambda s, _: F.when(valid(s), s).otherwise(step(s)))


def _ssn_ok(s: Column) -> Column:
    return s.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _email(m: Column, key: Column) -> Column:
    at = F.instr(m, "@")
    whose = F.concat_ws("|", key, F.lower(m.substr(at, F.length(m))))
    return let(whose, lambda k: let(m.substr(F.lit(1), at - 1), lambda p: F.concat(permute_chars(p, F.lit(0), k, "email"), m.substr(at, F.length(m)))))


def _flat(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


def _as_written(m: Column, flat: Column) -> Column:
    """flat's characters in the places of m's letters and digits: separators don't change the pseudonym of a number."""
    nth = lambda i: F.length(_flat(m.substr(F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), flat.substr(nth(i), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: Column) -> Column:
    front = let(_flat(m), lambda x: x.substr(F.lit(1), F.length(x) - 1))
    whole = let(front, lambda f: let(permute_chars(f, F.lit(0), key, "card"), lambda p: F.concat(p, luhn_digit(p))))
    return let(whole, lambda w: _as_written(m, w))


def _iban(m: Column, key: Column) -> Column:
    def made(p: Column) -> Column:
        check = F.lit(98) - mod97(F.concat(p.substr(F.lit(5), F.length(p)), F.substring(p, 1, 2), F.lit("00")))
        return F.concat(F.substring(p, 1, 2), F.lpad(check.cast("string"), 2, "0"), p.substr(F.lit(5), F.length(p)))

    # the check digits are set apart, so that the permutation doesn't depend on them
    apart = let(_flat(m), lambda x: F.concat(F.substring(x, 1, 2), F.lit("00"), x.substr(F.lit(5), F.length(x))))
    whole = let(apart, lambda x: let(permute_chars(x, F.lit(4), key, "iban"), made))
    return let(whole, lambda w: _as_written(m, w))


def _phone(m: Column, key: Column) -> Column:
    """Behind +, one to three digits of the country code stay."""
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])|^\+[0-9]", 0))
    fixed = F.when(code > 0, code - 1).otherwise(0).cast("int")
    whole = let(fixed, lambda n: let(_flat(m), lambda x: permute_chars(x, n, key, "phone")))
    return let(whole, lambda w: _as_written(m, w))


def _ipv4(m: Column, key: Column) -> Column:
    """Each number stays among those with as many digits: 10, 90 or 156 of them."""
    parts = F.split(m, r"\.")
    low = F.transform(parts, lambda x: F.when(F.length(x) == 1, 0).when(F.length(x) == 2, 10).otherwise(100).cast("long"))
    wide = F.transform(parts, lambda x: F.when(F.length(x) == 1, 10).when(F.length(x) == 2, 90).otherwise(156).cast("long"))
    shape = F.array_join(F.transform(parts, lambda x: F.length(x).cast("string")), "")
    values = F.zip_with(parts, low, lambda x, b: x.cast("long") - b)
    moved = lambda w, v, t: F.array_join(F.transform(F.zip_with(feistel(v, w, F.lit(2), t, "ipv4"), low, lambda x, b: x + b), lambda x: x.cast("string")), ".")
    return let(wide, lambda w: let(values, lambda v: let(F.concat_ws("|", key, shape), lambda t: moved(w, v, t))))


def _date_of(m: Column) -> Column:
    """The date that m writes, else null."""
    y_first = m.rlike("^[0-9]{4}[-/.]")
    us = m.rlike("^[0-9]{2}/")
    iso = F.when(y_first, F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))).when(us, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.when(iso >= "1600", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def _date(m: Column, key: Column) -> Column:
    """Dates from 1600 on, each within its 400 years."""
    wide = F.array(*[F.lit(x).cast("long") for x in DAYS])

    def moved(d: Column) -> Column:
        day = F.date_diff(d, F.lit("1600-01-01").cast("date")).cast("long")
        block = F.floor(day / (DAYS[0] * DAYS[1])).cast("long")
        inside = F.pmod(day, F.lit(DAYS[0] * DAYS[1]))
        split = F.array(F.floor(inside / DAYS[1]).cast("long"), F.pmod(inside, F.lit(DAYS[1])))
        to = let(split, lambda s: let(wide, lambda w: feistel(s, w, F.lit(1), key, "date")))
        after = let(to, lambda t: F.date_add(F.lit("1600-01-01").cast("date"), (block * (DAYS[0] * DAYS[1]) + F.get(t, 0) * DAYS[1] + F.get(t, 1)).cast("int")))
        sep = F.when(m.rlike("^[0-9]{4}"), F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))

        def written(x: Column) -> Column:
            y, mo, da = F.lpad(F.year(x).cast("string"), 4, "0"), F.lpad(F.month(x).cast("string"), 2, "0"), F.lpad(F.day(x).cast("string"), 2, "0")
            return F.when(m.rlike("^[0-9]{4}"), F.concat(y, sep, mo, sep, da)).when(sep == "/", F.concat(mo, sep, da, sep, y)).otherwise(F.concat(da, sep, mo, sep, y))

        return let(after, written)

    return let(_date_of(m), moved)


def _valid(kind: str, m: Column) -> Column:
    """Is m, all of it, a valid value of the kind?"""
    full = m.rlike(f"^(?:{PATTERNS[kind]})$")
    if kind == "email":
        return F.contains(m, F.lit("@"))
    if kind == "iban":
        flat = F.regexp_replace(m, "[ -]", "")
        return full & (mod97(F.concat(flat.substr(F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1)
    if kind == "date":
        return full & _date_of(m).isNotNull()
    if kind == "ssn":
        return full & _ssn_ok(m)
    if kind == "phone":
        return full & F.length(_digits(m)).between(8, 15)
    if kind == "ipv4":
        return full & ~F.exists(F.split(m, r"\."), lambda x: (x.cast("int") > 255) | x.rlike("^0[0-9]"))
    return full & F.call_function("luhn_check", _digits(m))


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY that is valid, else null."""
    return F.when(F.contains(m, F.lit("@")), "email").when(m.rlike("^[A-Z]{2}"), F.when(_valid("iban", m), "iban")).otherwise(F.coalesce(*[F.when(_valid(k, m), k) for k in KINDS if k not in ("email", "iban")]))


def _country_length(m: Column) -> Column:
    """How long IBANs of m's country are; null where unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LENGTHS.items() for x in pair]), F.substring(m, 1, 2))


_PIECES = "array<struct<kind:string,value:string>>"


def _piece(kind, value) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), value.alias("value"))


def _pieces(text: Column, begins: str, find, mail: bool = False) -> Column:
    """array<struct<kind, value>>: text in order, parted at what find() sees at the start of a window behind its first character."""

    def of(atoms: Column) -> Column:
        joined = lambda at, n: F.array_join(F.slice(atoms, at + 1, n), "")

        def step(state: Column, i: Column) -> Column:
            window = lambda n: F.concat(F.when(i > 0, F.get(atoms, i - 1)).otherwise("\n").substr(-1, 1), joined(i, F.lit(n)))
            whole = let(window(WINDOW), lambda w: F.when(w.rlike(MAIL_BEGINS), window(MAIL_WINDOW)).otherwise(w)) if mail else window(WINDOW)
            seen = F.when((i >= state["next"]) & F.get(atoms, i).rlike(begins), let(whole, find))

            def taken(value: Column) -> Column:
                n = F.size(F.regexp_extract_all(value["value"], F.lit(ATOM), F.lit(0)))
                hit = F.struct(i.alias("at"), (i + n).alias("to"), value["kind"].alias("kind"), value["value"].alias("value"))
                return F.when(value.isNull(), state).otherwise(F.struct((i + n).alias("next"), F.concat(state["hits"], F.array(hit)).alias("hits")))

            return let(seen, taken)

        def parted(hits: Column) -> Column:
            end = lambda k: F.coalesce(F.get(hits, k)["to"], F.lit(0))
            both = F.flatten(F.transform(hits, lambda h, k: F.array(_piece(None, joined(end(k - 1), h["at"] - end(k - 1))), _piece(h["kind"], h["value"]))))
            last = end(F.size(hits) - 1)
            return F.concat(both, F.array(_piece(None, joined(last, F.size(atoms) - last))))

        none = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,to:int,kind:string,value:string>>").alias("hits"))
        return let(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(atoms) - 1, F.lit(0))), none, step)["hits"], parted)

    return F.when(text == "", F.array(_piece(None, text))).otherwise(let(F.regexp_extract_all(text, F.lit(ATOM), F.lit(0)), of))


def _sure(window: Column) -> Column:
    """A card in one of SHAPES, or an IBAN of its country's length."""
    card = F.regexp_extract(window, f"(?s)(?<=^.)(?:{SHAPES}){_W}", 0)
    n = _country_length(window.substr(2, 2))
    iban = F.call_function("regexp_extract", window, F.concat(F.lit("(?s)(?<=^.)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){"), (n - 4).cast("string"), F.lit(f"}}{_W}")), F.lit(0))
    one = lambda kind, m: let(m, lambda x: F.when((x != "") & _valid(kind, x), _piece(F.lit(kind), x)))
    return F.coalesce(one("card", card), F.when(n.isNotNull(), one("iban", iban)))


def _any(window: Column) -> Column:
    """A value of any kind, kinds by precedence. Numbers that can go on behind a separator are tried from long to short."""

    def shorter(m: Column) -> Column:
        return let(F.regexp_extract_all(m, F.lit(ATOM), F.lit(0)), lambda p: F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(p, F.lit(1), k), "")))

    def options(kind: str, m: Column) -> Column:
        if kind == "iban":  # a known country's are whole or none: _sure() has seen the right length
            return F.when(_country_length(m).isNull(), shorter(m)).otherwise(F.array(m))
        if kind == "card":
            return F.concat(F.array(F.regexp_extract(m, rf"^[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}{_W}", 0)), shorter(m))
        return shorter(m) if kind == "phone" else F.array(m)

    def one(kind: str) -> Column:
        found = F.regexp_extract(window, f"(?s)(?<=^.)(?:{PATTERNS[kind]})", 0)
        best = lambda m: F.get(F.filter(options(kind, m), lambda x: (x != "") & _valid(kind, x)), 0)
        return let(found, lambda m: F.when(m != "", let(best(m), lambda x: F.when(x.isNotNull(), _piece(F.lit(kind), x)))))

    return F.coalesce(*map(one, KINDS))


def _lines(text: Column) -> Column:
    """array<struct<kind, value>> of a text, line by line: what is sure, and the gaps."""
    line = lambda x: F.when(x.rlike(HINT), _pieces(x, "^(?:[2-6]|[A-Z]{2}[0-9]{2})", _sure)).otherwise(F.array(_piece(None, x)))
    return F.flatten(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat(F.when(i > 0, F.array(_piece(None, F.lit("\n")))).otherwise(F.array().cast(_PIECES)), line(x))))


def _gaps(pieces: Column) -> Column:
    """The same with values of all kinds told apart in the gaps."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull() & p["value"].rlike(HINT), _pieces(p["value"], "^[0-9A-Za-z(+._%-]", _any, mail=True)).otherwise(F.array(p))))


def _doubtful(found: Column) -> Column:
    """Is a match invalid, or may it hold characters of a neighbour?"""
    card = (found["kind"] == "card") & ~found["value"].rlike(f"^(?:{SHAPES})$")
    iban = (found["kind"] == "iban") & (F.length(_flat(found["value"])) != _country_length(found["value"]))
    return found["kind"].isNull() | card | F.coalesce(iban, F.lit(False))


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """m, of a valid kind, permuted within its format; m and kind must be bound."""
    return (
        F.when(kind == "email", _email(m, key))
        .when(kind == "card", _card(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ipv4", _ipv4(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "ssn", _walk(m, lambda s: let(s, lambda x: permute_chars(x, F.lit(0), key, "ssn")), _ssn_ok))
        .otherwise(m)
    )


def _hidden(spark: SparkSession, key: str | None) -> Column:
    """The key as the only value of a table, so that plans name its column and nothing else."""
    key = spark.conf.get(KEY_SETTING, None) if key is None else key
    if not key:
        raise ValueError(f"no key for pseudonyms: pass one or set {KEY_SETTING}")
    return spark.createDataFrame([(key,)], "pii_key string").scalar()


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with text_col's values replaced, and pii_kinds array<string>."""
    text, found, pieces, secret = F.col(text_col), F.col("__found"), F.col("__pieces"), F.col("__key")
    none = F.array().cast(_PIECES)
    ends = F.concat(found, F.array(_piece(None, F.lit(""))))
    plain = F.flatten(F.zip_with(F.split(text, ANY, -1), ends, lambda g, f: F.array(_piece(None, F.coalesce(g, F.lit(""))), f)))
    put = lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(let(p["value"], lambda m: let(p["kind"], lambda k: pseudonym(m, k, secret))))
    # one step after another: the analyzer doesn't resolve all of it nested
    rows = spread(docs).withColumn("__found", F.when(text.rlike(HINT), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _piece(kind_of(m), m))).otherwise(none))
    rows = rows.withColumn("__again", F.exists(found, _doubtful) | ((F.size(found) > 0) & text.rlike(CROWDED)))
    rows = rows.withColumn("__pieces", F.when(F.col("__again"), _lines(text)).when(F.size(found) > 0, plain).otherwise(F.array(_piece(None, text))))
    rows = rows.withColumn("__pieces", F.when(F.col("__again"), _gaps(pieces)).otherwise(pieces)).withColumn("__key", _hidden(docs.sparkSession, key))
    kinds = F.filter(F.transform(pieces, lambda p: p["kind"]), lambda k: k.isNotNull())
    rows = rows.withColumn("__text", F.when(F.size(found) > 0, F.array_join(F.transform(pieces, put), "")).otherwise(text)).withColumn("__kinds", kinds)
    names = [c for c in docs.columns if c != "pii_kinds"]
    return rows.select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in names], F.col("__kinds").alias("pii_kinds"))
