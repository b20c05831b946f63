"""Closed shapes against a plain recursive check, over good bodies and bodies that differ from them in one place or many."""

import copy
import json
import random

from pyspark.sql import functions as F

from siftwork import shapes
from siftwork.operators import gate, shape

GOOD = {
    "session_id": "s", "observation": {
        "observation_id": "o", "session_id": "s", "step": 1, "page": {"origin_class": "external", "url_template": "/", "title_raw": "é", "type_hint": "form", "modal_active": False, "stability": "stable"},
        "viewport": {"w": 1, "h": 1.5, "scroll_y_pct": 0, "doc_h_ratio": 1e300, "dpr": 2}, "truncated": False, "list_virtualized": False, "frames": [{"id": 0, "origin": "same", "rect": [0, 0, 1, 1]}], "handles": [{"handle": "⟦T#1⟧", "type": "T", "tier": 1, "occurrences": 2, "first_seen_step": 0}],
        "elements": [{"id": "e1", "id_hash": "h", "tag": "a", "role": "link", "label_raw": "x", "rect": [0, 1, 2, 3.5], "visible": True, "enabled": True, "focusable": True, "value_state": "n/a", "group": "", "frame": 0, "available_actions": ["CLICK"]}],
        "text_nodes": [{"id": "t", "rect": [0, 0, 1, 1], "text": "x", "owner_element_id": None, "source": "dom"}]},
    "history": [{"action": {"type": "TYPE", "target": {"id": "a", "id_hash": "b"}, "value": {"kind": "literal", "text": "x"}}, "observation_id": "o", "step_index": 0, "session_id": "s", "risk": "low"}, {"action": {"type": "BACK"}, "observation_id": "o", "step_index": 0, "session_id": "s", "risk": "low"}],
    "screenshot": {"__redactedImageBrand": "__redactedImageBrand", "mime": "image/png", "data_base64": "", "width": 3, "height": 4, "redaction_count": 0},
}


def told(v, s, path=""):
    """The faults of a value, by plain recursion."""
    at = lambda k: f"{path}.{k}" if path else k
    if "oneOf" in s:
        if not isinstance(v, dict):
            return [(path, "type")]
        name = next(k for k, x in s["oneOf"][0]["properties"].items() if "const" in x)
        if name not in v:
            return [(at(name), "missing")]
        mine = [x for x in s["oneOf"] if v[name] == x["properties"][name]["const"] and isinstance(v[name], str)]
        return told(v, mine[0], path) if mine else [(at(name), "value")]
    kinds = [s["type"]] if isinstance(s["type"], str) else s["type"]
    if v is None and "null" in kinds:
        return []
    kind = kinds[0]
    is_number = isinstance(v, (int, float)) and not isinstance(v, bool)
    fits = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "number": is_number, "integer": is_number and v == int(v)}[kind]
    if not fits:
        return [(path, "type")]
    out = []
    if kind == "object":
        out += [(at(k), "missing") for k in s["required"] if k not in v] + [(at(k), "unknown") for k in v if k not in s["properties"]]
        for k, x in s["properties"].items():
            out += told(v[k], x, at(k)) if k in v else []
    elif kind == "array":
        out += [(path, "size")] * (not s.get("minItems", 0) <= len(v) <= s.get("maxItems", 1 << 30))
        for i, x in enumerate(v):
            out += told(x, s["items"], f"{path}[{i}]")
    elif ("enum" in s and v not in s["enum"]) or ("const" in s and v != s["const"]):
        out.append((path, "value"))
    elif kind == "string" and not s.get("minLength", 0) <= len(v) <= s.get("maxLength", 1 << 30) or is_number and (v < s.get("minimum", v) or ("exclusiveMinimum" in s and v <= s["exclusiveMinimum"])):
        out.append((path, "size"))
    return out


def places(x, path=()):
    yield path
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from places(v, (*path, k))


def spoilt(r):
    body = copy.deepcopy(GOOD)
    for _ in range(r.randint(1, 3)):
        path = r.choice([p for p in places(body) if p])
        at = body
        for k in path[:-1]:
            at = at[k]
        how = r.randint(0, 4)
        if how == 0 and isinstance(at, dict):
            del at[path[-1]]
        elif how == 1 and isinstance(at[path[-1]], dict):
            at[path[-1]][r.choice(["extra", "a.b", "é", "type"])] = r.choice([1, {"x": {}}, "CLICK"])
        elif how == 2 and isinstance(at[path[-1]], list):
            at[path[-1]] = at[path[-1]] * r.randint(0, 4)
        else:
            at[path[-1]] = r.choice([None, 1, -1, 2.5, "", "x" * 250, True, [], {}, "low", "kind", {"kind": "vault_ref", "handle": "h"}, {"type": "WAIT", "condition": "stable", "timeout_ms": 1}])
    return body


def test_every_fault_and_its_path(spark):
    r = random.Random(8)
    bodies = [GOOD] + [spoilt(r) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(b, ensure_ascii=i % 2 == 0)) for i, b in enumerate(bodies)], "i int, body string").repartition(2)
    got = {x.i: sorted((f.path, f.fault) for f in x.f) for x in df.select("i", shape.faults("body", shapes.STEP_REQUEST).alias("f")).collect()}
    assert not got[0]
    for i, b in enumerate(bodies):
        assert got[i] == sorted(told(b, shapes.STEP_REQUEST)), json.dumps(b)
    assert {f for v in got.values() for _, f in v} == {"missing", "unknown", "type", "value", "size"}


def test_texts_that_are_no_json(spark):
    good = json.dumps(GOOD)
    texts = [None, "", "nonsense", good + "}", good + "]", good + ", 1", "[" + good + "]", "[" * 100_000, '{"a":' * 100_000, '{"id":"a","id":"b","id_hash":"c"}']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").select("i", shape.faults("body", shapes.STEP_REQUEST).alias("f")).collect()
    kinds = {x.i: [tuple(f) for f in x.f] for x in got}
    assert all(kinds[i] == [("", "json")] for i in (0, 1, 2, 3, 4, 5, 7, 8, 9)) and kinds[6] == [("", "type")]


def test_deep_and_odd_payloads_fail_the_gate_and_no_job(spark):
    rows = [(1, "s", 1, "/v1/step", "[" * 100_000 + "]" * 100_000, "https://g/x"), (2, "s", 2, "/v1/step", json.dumps(GOOD), "https://g/x"), (3, "s", 3, "/v1/health", "{}", "https://g/x"), (4, "s", 4, "/v1/health", None, "https://g/x")]
    df = spark.createDataFrame(rows, "payload_id long, session string, ms long, path string, body string, destination string")
    nothing = spark.createDataFrame([], "secret string, tier int")
    got = {x.payload_id: x.code for x in gate.gate(df, nothing, shapes.BODIES, "https://g", 100_000).collect()}
    assert got == {1: "SCHEMA_CONFORMANCE", 2: None, 3: "SCHEMA_CONFORMANCE", 4: None}
    nested = [(1, '{"a":["x",{"b":"y"}],"c":"z"}'), (2, '{"a":' * 100_000), (3, None)]
    strings = gate.json_strings(spark.createDataFrame(nested, "k long, body string"), "k", "body")
    assert [tuple(x) for x in strings.orderBy("nth").collect()] == [(1, 0, "a[0]", "x"), (1, 1, "a[1].b", "y"), (1, 2, "c", "z")]


def test_documents_out(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):  # writing again replaces
        shape.export(spark, {"Target": shapes.TARGET, "Action": shapes.ACTION}, path)
    back = {x.name: json.loads(x.json) for x in spark.read.json(path).collect()}
    assert back["Target"]["definitions"]["Target"] == shapes.TARGET and set(back["combined"]["definitions"]) == {"Target", "Action"}
    assert back["Target"]["definitions"]["Target"]["additionalProperties"] is False
    rows = spark.range(1).select("id", F.lit("x").alias("s"), F.array(F.struct(F.lit(1.5).alias("d"))).alias("a"), F.create_map(F.lit("k"), F.lit(True)).alias("m"))
    of = shape.of_rows(rows.schema)
    assert of["properties"]["a"]["items"]["properties"]["d"]["type"] == "number" and of["properties"]["m"]["additionalProperties"]["type"] == "boolean" and of["required"] == ["id", "s", "a", "m"]
    assert not rows.select(F.to_json(F.struct("*")).alias("body")).select(shape.faults("body", of).alias("f")).first().f
