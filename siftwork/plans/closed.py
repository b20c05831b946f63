"""Closed shapes over the driver's events: each is told as the envelope of a planner's action, whose deviations come from the event's own columns. The twins take the same text apart as a tree and
compare it with a table of allowed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import shapes
from siftwork.operators import gate, shape
from siftwork.plans.probes import q
from siftwork.tables import new_path

QUERIES, ORACLES = {}, {}

#: SQL that both engines take.
_TARGET = """concat('{"id":"e', user_id, '","id_hash":', CASE WHEN value > 20 THEN cast(value AS STRING) ELSE '"h"' END, CASE WHEN value > 15 THEN concat(',"meta":', props) ELSE '' END, '}')"""
_ACTION = f"""CASE event_type WHEN 'click' THEN concat('{{"type":"CLICK","target":', {_TARGET}, '}}') WHEN 'view' THEN concat('{{"type":"SCROLL","direction":"', CASE WHEN value < 10 THEN 'down' ELSE 'sideways' END, '","amount":', cast(value AS STRING), '}}')
  WHEN 'error' THEN concat('{{"type":"DONE","outcome":"', CASE WHEN value < 5 THEN 'blocked' ELSE 'broken' END, '"}}') WHEN 'purchase' THEN concat('{{"type":"SELECT","target":', {_TARGET}, ',"option_index":', CASE WHEN value < 10 THEN '2' ELSE '"2"' END, '}}')
  ELSE concat('{{"type":"', event_type, '","target":', {_TARGET}, '}}') END"""
BODY = f"""concat('{{"action":', CASE WHEN value > 40 THEN 'null' ELSE {_ACTION} END, ',"observation_id":"o', user_id, '","step_index":', cast(value AS STRING), CASE WHEN value < 2 THEN '' ELSE concat(',"session_id":"s', user_id, '"') END, ',"risk":"', CASE WHEN value < 25 THEN 'low' ELSE event_type END, '"', CASE WHEN value > 30 THEN concat(',"debug":', props) ELSE '' END, '}}', CASE WHEN value > 45 THEN '}}' ELSE '' END)"""


def bodies(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("payload_id"), F.expr(BODY).alias("body"))


def _allowed() -> str:
    """(kind, path, type, required, words) of the envelope; kind is * outside the action."""
    types = {"string": "VARCHAR", "number": "NUMBER", "integer": "NUMBER", "boolean": "BOOLEAN", "object": "OBJECT"}
    rows = []

    def add(kind: str, s: dict, path: str) -> None:
        for name, x in s["properties"].items():
            if "oneOf" in x:
                rows.append((kind, f"{path}.{name}", "OBJECT", name in s["required"], []))
            else:
                rows.append((kind, f"{path}.{name}", types[x["type"]], name in s["required"], [x["const"]] if "const" in x else x.get("enum", [])))
                if x["type"] == "object":
                    add(kind, x, f"{path}.{name}")

    add("*", shapes.ENVELOPE, "$")
    for one in shapes.ACTION["oneOf"]:
        add(one["properties"]["type"]["const"], one, "$.action")
    return ", ".join(f"({q(k)}, {q(p)}, {q(t)}, {r}, [{', '.join(map(q, w))}]::VARCHAR[])" for k, p, t, r, w in rows)


_KINDS = ", ".join(q(one["properties"]["type"]["const"]) for one in shapes.ACTION["oneOf"])
_SQL = f"""WITH e AS (SELECT event_id, {BODY.replace('AS STRING', 'AS VARCHAR')} AS body FROM events),
j AS (SELECT event_id, body, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM e),
a(kind, path, type, required, words) AS (VALUES {_allowed()}),
k AS (SELECT event_id, j, CASE WHEN json_type(j, '$.action.type') = 'VARCHAR' THEN j ->> '$.action.type' END AS kind FROM j WHERE ok),
n AS (SELECT event_id, kind, x.fullkey AS path, x.path AS parent, CASE WHEN x.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'NUMBER' ELSE x.type END AS type, CASE WHEN x.type = 'VARCHAR' THEN x.atom ->> '$' END AS said FROM k, json_tree(k.j) AS x),
o AS (SELECT n.*, kind IN ({_KINDS}) AS told FROM n),
known AS (SELECT DISTINCT o.event_id, o.path, o.type, o.said, a.type AS want, a.words FROM o JOIN a ON a.path = o.path AND (a.kind = '*' OR (a.kind = o.kind AND o.told))),
objects AS (SELECT event_id, path FROM o WHERE path = '$' UNION ALL SELECT event_id, path FROM known WHERE type = 'OBJECT' AND want = 'OBJECT'),
f AS (
  SELECT event_id, '' AS path, 'json' AS fault FROM j WHERE NOT ok
  UNION ALL SELECT o.event_id, o.path, 'unknown' FROM o JOIN objects b ON b.event_id = o.event_id AND b.path = o.parent WHERE o.path <> '$' AND (o.parent <> '$.action' OR o.told) AND NOT EXISTS (SELECT 1 FROM known w WHERE w.event_id = o.event_id AND w.path = o.path)
  UNION ALL SELECT b.event_id, a.path, 'missing' FROM objects b JOIN k USING (event_id) JOIN a ON a.required AND regexp_replace(a.path, '\\.[^.]*$', '') = b.path AND (a.kind = '*' OR a.kind = k.kind) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.event_id = b.event_id AND o.path = a.path)
  UNION ALL SELECT event_id, path, 'type' FROM known WHERE type <> want
  UNION ALL SELECT event_id, path, 'value' FROM known WHERE type = want AND len(words) > 0 AND NOT list_contains(words, said)
  UNION ALL SELECT b.event_id, '$.action.type', CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.event_id = b.event_id AND o.path = '$.action.type') THEN 'value' ELSE 'missing' END FROM objects b JOIN k USING (event_id) WHERE b.path = '$.action' AND (k.kind IS NULL OR k.kind NOT IN ({_KINDS}))
)"""


def gate_shapes(spark, sf_dir: str) -> DataFrame:
    """Every fault of every body with its path."""
    found = bodies(spark, sf_dir).select("payload_id", F.explode(shape.faults("body", shapes.ENVELOPE)).alias("f"))
    return found.select("payload_id", "f.path", "f.fault")


def gate_shape_codes(spark, sf_dir: str) -> DataFrame:
    """What the gate says of them: each body that has a fault, once; a path without a shape takes no body."""
    path = F.when(F.col("payload_id") % 10 == 0, "/v1/health").otherwise("/v1/act")
    return gate.schema_check(bodies(spark, sf_dir).withColumn("path", path), {"/v1/act": shapes.ENVELOPE}).select("payload_id", "code")


def snk_schema(spark, sf_dir: str) -> DataFrame:
    """JSON Schema documents of what crosses the wire and of the tables at hand, read back from where they were written, with the number of fields of each."""
    rows = {name: shape.of_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema) for name in ("orders", "customer", "part", "supplier", "nation", "region")}
    path = new_path(spark, "schemas")
    shape.export(spark, shapes.ALL | rows, path)
    back = spark.read.json(path).where(F.col("name").isin(*rows))
    of = F.try_element_at(F.from_json("json", "definitions map<string,struct<properties:map<string,string>>>")["definitions"], F.col("name"))
    return back.select("name", F.explode(of["properties"]).alias("field", "told")).select("name", "field", F.regexp_replace(F.get_json_object("told", "$.type"), r'[\["\]]|,"null"', "").alias("type"))


_JSON_TYPES = "CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer' WHEN data_type = 'DOUBLE' OR data_type = 'FLOAT' OR data_type LIKE 'DECIMAL%' THEN 'number' WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END"
QUERIES |= {"gate_shapes": gate_shapes, "gate_shape_codes": gate_shape_codes, "snk_schema": snk_schema}
ORACLES["gate_shapes"] = f"{_SQL} SELECT event_id AS payload_id, regexp_replace(path, '^\\$\\.', '') AS path, fault FROM f"
ORACLES["gate_shape_codes"] = f"{_SQL} SELECT event_id AS payload_id, 'SCHEMA_CONFORMANCE' AS code FROM (SELECT event_id FROM f UNION SELECT event_id FROM e WHERE event_id % 10 = 0)"
ORACLES["snk_schema"] = f"SELECT table_name AS name, column_name AS field, {_JSON_TYPES} AS type FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'part', 'supplier', 'nation', 'region')"
