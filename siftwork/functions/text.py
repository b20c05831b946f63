"""Text columns: spans of a pattern with offsets, context, normal forms, encodings, n-grams."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: White space as JavaScript has it.
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def java(pattern: str) -> str:
    r"""\b between ASCII words, for Java's engine, whose own \b takes accented letters for word characters."""
    return pattern.replace(r"\b", _EDGE)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def running(sizes: Column, block: int = 256):
    """A function of i: the sum of the first i numbers of an array. Sums of blocks are added up once, so that none is added for every i again."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int"))
    ends = F.aggregate(blocks, F.array(F.lit(0)), lambda done, b: F.array_append(done, F.element_at(done, -1) + total(F.slice(sizes, b * block + 1, block))))

    def upto(ends: Column):
        at = lambda i: F.floor(i / block).cast("int")
        return lambda i: F.get(ends, at(i)) + F.when(i % block == 0, 0).otherwise(total(F.slice(sizes, at(i) * block + 1, i % block)))

    return lambda body: let(ends, lambda e: body(upto(e)))


#: Characters around a span that spans() can tell.
NEAR = 30


def spans(text: Column, pattern: str, near: bool = False) -> Column:
    """array<struct<start, end, value>>: leftmost matches that don't overlap, offsets in code points, end exclusive. Null text: null.
    near: with lead and trail, up to NEAR characters on either side, put together from the pieces beside a match, so that the text isn't gone through for each."""
    pattern = java(pattern)
    none = F.array().cast(f"array<struct<start:int,end:int,value:string{',lead:string,trail:string' if near else ''}>>")
    joined = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, y)), "")

    def placed(m: Column) -> Column:
        def sides(gaps: Column, i: Column) -> list[Column]:
            # matches have six characters or more: five pieces are enough
            front, back = F.get(gaps, i), F.get(gaps, i + 1)
            at, n = F.greatest(i - 5, F.lit(0)) + 1, F.least(i, F.lit(5))
            lead = F.when(F.length(front) >= NEAR, F.right(front, F.lit(NEAR))).otherwise(F.right(F.concat(joined(F.slice(gaps, at, n), F.slice(m, at, n)), front), F.lit(NEAR)))
            trail = F.when(F.length(back) >= NEAR, F.left(back, F.lit(NEAR))).otherwise(F.left(F.concat(back, joined(F.slice(m, i + 2, F.lit(5)), F.slice(gaps, i + 3, F.lit(5)))), F.lit(NEAR)))
            return [lead.alias("lead"), trail.alias("trail")] if near else []

        def at(gaps: Column) -> Column:
            def of(sizes: Column) -> Column:
                one = lambda upto: lambda v, i: let(upto(i) + F.length(F.get(gaps, i)), lambda s: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value"), *sides(gaps, i)))
                return running(sizes)(lambda upto: F.transform(m, one(upto)))

            return let(F.transform(m, lambda v, i: F.length(F.get(gaps, i)) + F.length(v)), of)

        # a text without matches isn't parted
        return F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), at))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def before(s: Column, n: int = 1) -> Column:
    """Up to n characters in front of a span with its sides."""
    return F.right(s["lead"], F.lit(n))


def after(s: Column, n: int = 1) -> Column:
    return F.left(s["trail"], F.lit(n))


def normalize(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed. ASCII texts only need this; see normalize_any() for compatibility forms."""
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


@functools.cache
def unstable() -> str:
    """A class of all characters that NFKC changes, orders or may join to the one before; it leaves texts without any as they are. Ranges are nested by halves, so that a character meets few of them."""
    found = {0x1161 + i for i in range(21)} | {0x11A8 + i for i in range(27)}  # vowels and ends of Hangul syllables
    for c in (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000):
        parts = unicodedata.decomposition(chr(c)).split()
        if unicodedata.normalize("NFKC", chr(c)) != chr(c) or unicodedata.combining(chr(c)):
            found.add(c)
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(int(parts[1], 16))
    ends = sorted(found)
    ranges = list(zip([c for c in ends if c - 1 not in found], [c for c in ends if c + 1 not in found], strict=True))

    def among(rs: list[tuple[int, int]]) -> str:
        if len(rs) <= 4:
            return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in rs)
        half = len(rs) // 2
        return "".join(rf"[\x{{{r[0][0]:x}}}-\x{{{r[-1][1]:x}}}&&[{among(r)}]]" for r in (rs[:half], rs[half:]))

    return f"[{among(ranges)}]"


def normalize_any():
    """The same behind Unicode NFKC, as an Arrow UDF: Spark has no such function. Only texts with characters that it may change go to Python."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    # a branch alone keeps no text from Python: both are worked out for all rows
    changed = lambda text: text.rlike(unstable())
    return lambda text: normalize(F.coalesce(nfkc(F.when(changed(text), text)), text))


def normalize_numeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s.-]", "")


def _url(text: Column) -> Column:
    """Percent encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base64_utf8(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def encodings(value: Column) -> Column:
    """array<string>: the forms in which a value may hide, lower case, each once. For characters of the basic plane."""
    chars = F.split(value, "")
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
    hexa = lambda c, n: let(F.lower(F.hex(code(c))), lambda h: F.when(F.length(h) < n, F.lpad(h, n, "0")).otherwise(h))
    b64 = base64_utf8(value)
    named = F.replace(F.replace(value, F.lit("'"), F.lit("&apos;")), F.lit("/"), F.lit("&#x2F;"))
    forms = F.array(
        value,
        _url(value),
        _url(_url(value)),
        b64,
        F.replace(F.translate(b64, "+/", "-_"), F.lit("="), F.lit("")),
        F.array_join(F.transform(chars, lambda c: hexa(c, 2)), ""),
        F.array_join(F.transform(chars, lambda c: F.concat(F.lit("&#"), code(c).cast("string"), F.lit(";"))), ""),
        named,
        F.array_join(F.transform(chars, lambda c: F.concat(F.lit("\\\\u"), hexa(c, 4))), ""),
    )
    return F.array_distinct(F.transform(forms, F.lower))


def grams(text: Column, n: int = 8) -> Column:
    """array<string> of all runs of n characters, in order, repeats included."""
    # Java's engine also looks between the halves of a character beyond the basic plane
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{dc00}}-\x{{dfff}}])(?=(.{{{n}}}))"), F.lit(1))


def fill(template: Column, fields: Column) -> Column:
    """template with $person.name replaced by the value of the name in a map of strings, '' where there is none."""
    names = F.regexp_extract_all(template, F.lit(r"\$person\.([A-Za-z0-9_]+)"), F.lit(1))
    texts = F.split(template, r"\$person\.[A-Za-z0-9_]+", -1)
    put = lambda t, n: F.concat(t, F.coalesce(F.try_element_at(fields, n), F.lit("")))
    return F.array_join(F.zip_with(texts, F.concat(names, F.array(F.lit(""))), put), "")


def fenced_json(text: Column) -> Column:
    """variant: the object in a fenced block, else in the whole text, from its first brace to its last; null where that is no JSON."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    inside = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    return F.try_parse_json(F.nullif(F.regexp_extract(inside, r"(?s)\{.*\}", 0), F.lit("")))
