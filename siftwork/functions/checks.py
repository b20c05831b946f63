"""Check digits, entropy and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import schema

from .text import let


def _table(values) -> Column:
    return F.array(*map(F.lit, values))


def _verhoeff(digits: Column, shift: int) -> Column:
    d, p = _table(schema.VERHOEFF_D), _table(schema.VERHOEFF_P)
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.cast("int").alias("c"), i.alias("i")))
    return F.aggregate(each, F.lit(0), lambda c, x: F.get(d, c * 10 + F.get(p, F.pmod(x["i"] + shift, F.lit(8)).cast("int") * 10 + x["c"])))


def verhoeff_ok(digits: Column) -> Column:
    return _verhoeff(digits, 0) == 0


def verhoeff_digit(digits: Column) -> Column:
    """The digit to put behind digits."""
    return F.get(_table((0, 4, 3, 2, 1, 5, 6, 7, 8, 9)), _verhoeff(digits, 1))


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def luhn_digit(digits: Column) -> Column:
    twice = lambda c, i: let(c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(F.transform(F.reverse(F.split(digits, "")), twice), F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def gstin_char(front: Column) -> Column:
    """The 15th character by weights 1 to 14 modulo 36."""
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    total = F.aggregate(F.transform(F.split(front, ""), lambda c, i: value(c) * (i + 1)), F.lit(0), lambda a, x: a + x)
    return F.substring(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1, 36).substr(F.pmod(F.lit(36) - F.pmod(total, F.lit(36)), F.lit(36)).cast("int") + 1, F.lit(1))


def shannon(text: Column) -> Column:
    """Bits a character; empty: 0."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s - share(c) * F.log2(share(c))))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters (of the basic plane), in base 36."""
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
    step = lambda h, c: F.when(c == "", h).otherwise(((h.bitwiseXOR(code(c))) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), step).cast("string"), 10, 36))


def identity_hash(tag: Column, role: Column, name: Column, path: Column, rect: Column, frame: Column) -> Column:
    """What tells an element from others of its page: fnv1a() of its tag, role, name, path, place on a grid of four pixels, and frame."""
    place = F.concat_ws(",", *[(F.floor(rect[k] / 4 + 0.5) * 4).cast("string") for k in "xywh"])
    return fnv1a(F.concat_ws("|", F.lower(tag), role, F.lower(F.trim(name)), path, place, frame.cast("string")))
