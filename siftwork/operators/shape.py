"""Closed shapes of JSON: told as JSON Schema, compiled into one expression over variants that names every fault and its path.

A shape is a dictionary of JSON Schema (draft 7): type (object, array, string, number, integer, boolean, null, or a list with null), properties, required, additionalProperties, items, maxItems,
enum, const, minLength, maxLength, minimum, maximum, exclusiveMinimum, pattern, and oneOf by a constant property. The helpers below make closed objects: what isn't named in them is a fault at
every depth.

Faults: json (a text that isn't JSON, or nested deeper than the parser allows, or with a name twice), type, missing, unknown, value (enum, const, pattern, kind of a oneOf) and size (lengths and ranges). What is
of a wrong type isn't looked into. Null texts are no JSON. Each row is checked on its own, without Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAULT = "array<struct<path:string,fault:string>>"
_OPTIONAL = "x-optional"


# ---- telling shapes
def closed(**fields: dict) -> dict:
    """An object of these fields and no others; opt() marks those that may be missing."""
    plain = {k: {n: x for n, x in s.items() if n != _OPTIONAL} for k, s in fields.items()}
    return {"type": "object", "properties": plain, "required": [k for k, s in fields.items() if not s.get(_OPTIONAL)], "additionalProperties": False}


def opt(shape: dict) -> dict:
    return shape | {_OPTIONAL: True}


def array(items: dict, most: int | None = None) -> dict:
    return {"type": "array", "items": items} | ({} if most is None else {"maxItems": most})


def tuple_of(items: dict, n: int) -> dict:
    return {"type": "array", "items": items, "minItems": n, "maxItems": n}


def text(least: int | None = None, most: int | None = None, pattern: str | None = None) -> dict:
    return {"type": "string"} | {k: v for k, v in (("minLength", least), ("maxLength", most), ("pattern", pattern)) if v is not None}


def number(**limits: float) -> dict:
    return {"type": "number", **limits}


def integer(**limits: int) -> dict:
    return {"type": "integer", **limits}


def flag() -> dict:
    return {"type": "boolean"}


def word(*names: str) -> dict:
    return {"type": "string", "enum": list(names)}


def nullable(shape: dict) -> dict:
    return shape | {"type": [shape["type"], "null"]}


def by_kind(name: str, **kinds: dict) -> dict:
    """One of some closed objects, told apart by a constant property."""
    return {"oneOf": [s | {"properties": {name: {"type": "string", "const": k}} | s["properties"], "required": [name, *s["required"]]} for k, s in kinds.items()]}


# ---- checking: shapes become one SQL expression, which is parsed once (thousands of Column calls would take longer than the work itself)
class _Compiler:
    def __init__(self):
        self.n = 0

    def let(self, value: str, body) -> str:
        """body(name) with the value evaluated once for each row."""
        self.n += 1
        return f"transform(array({value}), x{self.n} -> {body(f'x{self.n}')})[0]"

    def fault(self, path: tuple[str, ...], fault: str) -> str:
        return f"array(named_struct('path', {_path(path)}, 'fault', '{fault}'))"

    def check(self, v: str, s: dict, path: tuple[str, ...]) -> str:
        """Faults of a variant; v is a name."""
        if "oneOf" in s:
            return self.one_of(v, s, path)
        kinds = [s["type"]] if isinstance(s.get("type"), str) else list(s.get("type", ()))
        if not kinds:
            return _NONE
        kind = next((k for k in kinds if k != "null"), "null")
        found = self.object(v, s, path) if kind == "object" else self.array(v, s, path) if kind == "array" else self.scalar(v, s, kind, path)
        return f"CASE WHEN is_variant_null({v}) THEN {_NONE} ELSE {found} END" if "null" in kinds and kind != "null" else found

    def object(self, v: str, s: dict, path: tuple[str, ...]) -> str:
        def inside(m: str) -> str:
            known = s.get("properties", {})
            told = lambda keys, fault: f"transform({keys}, k -> named_struct('path', {_path((*path, *_SEP[: len(path)], _Name('k')))}, 'fault', '{fault}'))"
            parts = []
            if s.get("required"):
                parts.append(told(f"filter(array({', '.join(map(_quoted, s['required']))}), k -> NOT map_contains_key({m}, k))", "missing"))
            if s.get("additionalProperties") is False:
                parts.append(told(f"array_sort(array_except(map_keys({m}), array({', '.join(map(_quoted, known))})))" if known else f"array_sort(map_keys({m}))", "unknown"))
            for name, sub in known.items():
                at = (*path, *_SEP[: len(path)], name)
                value = self.let(f"try_element_at({m}, {_quoted(name)})", lambda x, sub=sub, at=at: self.check(x, sub, at))
                parts.append(f"CASE WHEN map_contains_key({m}, {_quoted(name)}) THEN {value} ELSE {_NONE} END")
            return f"concat({', '.join(parts)})" if parts else _NONE

        return self.let(f"try_variant_get({v}, '$', 'map<string,variant>')", lambda m: f"CASE WHEN {m} IS NULL THEN {self.fault(path, 'type')} ELSE {inside(m)} END")

    def array(self, v: str, s: dict, path: tuple[str, ...]) -> str:
        def inside(a: str) -> str:
            self.n += 1
            x, i = f"x{self.n}", f"i{self.n}"
            each = f"flatten(transform({a}, ({x}, {i}) -> {self.check(x, s.get('items', {}), (*path, '[', _Name(f'string({i})'), ']'))}))"
            return f"concat(CASE WHEN size({a}) NOT BETWEEN {s.get('minItems', 0)} AND {s.get('maxItems', 1 << 30)} THEN {self.fault(path, 'size')} ELSE {_NONE} END, {each})"

        return self.let(f"try_variant_get({v}, '$', 'array<variant>')", lambda a: f"CASE WHEN {a} IS NULL THEN {self.fault(path, 'type')} ELSE {inside(a)} END")

    def scalar(self, v: str, s: dict, kind: str, path: tuple[str, ...]) -> str:
        d, x = f"try_variant_get({v}, '$', 'double')", f"try_variant_get({v}, '$', 'string')"

        def inside(told: str) -> str:
            numeric = f"({told} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({told}, 'DECIMAL'))"
            fits = {"string": f"{told} = 'STRING'", "boolean": f"{told} = 'BOOLEAN'", "number": numeric, "integer": f"{numeric} AND {d} = floor({d})", "null": f"{told} = 'VOID'"}[kind]
            value = [f"{x} = {_quoted(s.get('const', ''))}"] * ("const" in s) + [f"{x} IN ({', '.join(map(_quoted, s.get('enum', ())))})"] * ("enum" in s) + [f"{x} RLIKE {_quoted(s.get('pattern', ''))}"] * ("pattern" in s)
            size = [f"length({x}) BETWEEN {s.get('minLength', 0)} AND {s.get('maxLength', (1 << 31) - 1)}"] * ("minLength" in s or "maxLength" in s)
            size += [f"{d} {op} {s[n]!r}D" if isinstance(s[n], float) else f"{d} {op} {s[n]}" for n, op in (("minimum", ">="), ("maximum", "<="), ("exclusiveMinimum", ">")) if n in s]
            cases = [(fits, "type"), *((c, "value") for c in value), *((c, "size") for c in size)]
            return f"CASE {' '.join(f'WHEN NOT coalesce({c}, false) THEN {self.fault(path, f)}' for c, f in cases)} ELSE {_NONE} END"

        return self.let(f"schema_of_variant({v})", inside)

    def one_of(self, v: str, s: dict, path: tuple[str, ...]) -> str:
        """The kinds' constant property decides which of them a value has to be."""
        name = next(k for k, x in s["oneOf"][0]["properties"].items() if "const" in x)
        at = (*path, *_SEP[: len(path)], name)

        def inside(m: str) -> str:
            kind = f"CASE WHEN schema_of_variant(try_element_at({m}, {_quoted(name)})) = 'STRING' THEN try_variant_get(try_element_at({m}, {_quoted(name)}), '$', 'string') END"
            branches = lambda k: " ".join(f"WHEN {k} = {_quoted(one['properties'][name]['const'])} THEN {self.object(v, one, path)}" for one in s["oneOf"])
            return f"CASE WHEN {m} IS NULL THEN {self.fault(path, 'type')} WHEN NOT map_contains_key({m}, {_quoted(name)}) THEN {self.fault(at, 'missing')} ELSE {self.let(kind, lambda k: f'CASE {branches(k)} ELSE {self.fault(at, "value")} END')} END"

        return self.let(f"try_variant_get({v}, '$', 'map<string,variant>')", inside)


class _Name(str):
    """A part of a path that is an expression."""


_NONE = f"cast(array() AS {FAULT})"
_SEP = (".",)


def _quoted(x: str) -> str:
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path(parts: tuple[str, ...]) -> str:
    merged: list[str] = []
    for x in parts:
        if merged and not isinstance(x, _Name) and not isinstance(merged[-1], _Name):
            merged[-1] += x
        else:
            merged.append(x)
    each = [x if isinstance(x, _Name) else _quoted(x) for x in merged]
    return f"concat({', '.join(each)})" if len(each) > 1 else each[0] if each else "''"


def expression(body: str, s: dict) -> str:
    """SQL of the faults of a JSON text, told as SQL."""
    c = _Compiler()
    # Spark's parser stops behind the first value: what follows it is seen where the text is put into an array and into an object
    whole = f"CASE WHEN try_parse_json(concat('{{\"x\":', {body}, '}}')) IS NOT NULL THEN try_variant_get(try_parse_json(concat('[', {body}, ']')), '$', 'array<variant>') END"
    found = c.let("a[0]", lambda v: c.check(v, s, ()))
    return f"transform(array({whole}), a -> CASE WHEN a IS NULL OR size(a) <> 1 THEN {c.fault((), 'json')} ELSE {found} END)[0]"


def faults(body: str, s: dict) -> Column:
    """array<struct<path, fault>> of a column of JSON texts."""
    return F.expr(expression(f"`{body}`", s))


# ---- JSON Schema out
def of_rows(kind: T.DataType) -> dict:
    """The shape of rows of a Spark type, as they are written as JSON."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: nullable_of(of_rows(f.dataType)) if f.nullable else of_rows(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": nullable_of(of_rows(kind.elementType)) if kind.containsNull else of_rows(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": nullable_of(of_rows(kind.valueType)) if kind.valueContainsNull else of_rows(kind.valueType)}
    if isinstance(kind, T.VariantType):
        return {}
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return {"type": "boolean" if isinstance(kind, T.BooleanType) else "integer" if whole else "number" if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else "string"}


def nullable_of(s: dict) -> dict:
    return s | {"type": [s["type"], "null"]} if isinstance(s.get("type"), str) else s


def document(name: str, s: dict) -> str:
    return json.dumps({"$schema": "http://json-schema.org/draft-07/schema#", "$ref": f"#/definitions/{name}", "definitions": {name: s}}, indent=2, ensure_ascii=False)


def export(spark: SparkSession, shapes: dict[str, dict], path: str) -> DataFrame:
    """Write (name, json) rows, a document for each shape and one of all named combined, as a table of JSON lines in a folder by name. Writing again replaces what is there."""
    both = {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": shapes}
    rows = [(n, document(n, s)) for n, s in shapes.items()] + [("combined", json.dumps(both, indent=2, ensure_ascii=False))]
    out = spark.createDataFrame(rows, "name string, json string")
    out.repartition("name").write.mode("overwrite").partitionBy("name").json(path)
    return out
