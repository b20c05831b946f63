"""Queries of labels, form fields and pages. The observations are written here; each of them stands for many pages, one for every page of the driver's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import context
from siftwork.sources import pages

#: (ord, text, x, y, w, h) of five small observations.
NODES = (
    (0, ((0, "Name", 0, 0, 80, 20), (1, "Vivek Gupta", 100, 0, 90, 20), (2, "City:", 0, 30, 80, 20), (3, "Nagpur", 100, 30, 90, 20))),
    (1, ((0, "Phone: +91 99194 14773", 0, 0, 200, 20), (1, "Status: active", 0, 30, 200, 20), (2, "E-mail : a@b.co", 0, 60, 200, 20), (3, "Name: Pending", 0, 90, 200, 20))),
    (2, ((0, "State", 0, 0, 80, 20), (1, "Delivered", 100, 0, 90, 20), (2, "Town", 0, 30, 80, 20), (3, "Far away", 100, 300, 90, 20), (4, "PIN", 0, 400, 80, 20), (5, "440001", 90, 400, 80, 20))),
    (3, ((0, "Name", 0, 0, 100, 20), (1, "MRN", 120, 0, 100, 20), (2, "Phone", 240, 0, 100, 20), (3, "Asha Rao", 0, 40, 100, 20), (4, "MR-1001", 120, 40, 100, 20), (5, "98765 43210", 240, 40, 100, 20), (6, "Ravi Das", 0, 80, 100, 20), (7, "MR-1002", 120, 80, 100, 20), (8, "91234 56780", 240, 80, 100, 20))),
    (4, ((0, "Pan", 0, 0, 80, 20), (1, "abcde1234f", 100, 0, 90, 20), (2, "Address", 0, 30, 80, 20), (3, "⟦ADDRESS#1⟧", 100, 30, 90, 20))),
)
#: (id, tag, type, input_type, autocomplete, maxlength, label, placeholder)
FIELDS = (
    (0, "input", None, "password", None, None, "Password", None), (1, "input", None, "text", "shipping street-address", None, "Street", None), (2, "input", None, "text", None, 6, "Code", "123456"),
    (3, "input", None, "text", None, 6, "Pass", ""), (4, "input", None, "text", "cc-number", None, "Card number", None), (5, "input", None, "text", None, None, "CVV", "3 digits"), (6, "input", None, "text", None, None, "PAN number", None),
    (7, "input", None, "search", None, None, "Mobile", None), (8, "textarea", None, None, None, None, "Your address", "House, street"), (9, "input", None, "text", None, None, "Search by city", None), (10, "select", None, None, None, None, "State", None),
    (11, "input", None, "email", "email", None, "E-mail", None), (12, "input", None, "text", None, None, "Enter the code sent to you", None), (13, "button", None, None, None, None, "Next", None), (14, "input", None, "tel", None, None, "Mobile", None),
    (15, "input", None, "text", None, None, "Discard", None), (16, "input", None, "text", "name bday", None, None, None), (17, "input", None, "text", None, None, "OTP", None),
)


def nodes(spark, sf_dir):
    rows = [(o, i, f"{o}-{i}", t, *map(float, r)) for o, page in NODES for i, t, *r in page]
    made = F.broadcast(spark.createDataFrame(rows, "kind int, ord int, part string, text string, x double, y double, w double, h double"))  # a fixed number of rows
    each = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("obs"), F.pmod("page_id", F.lit(len(NODES))).cast("int").alias("kind"))
    return each.join(made, "kind").select("obs", "ord", F.concat_ws("-", F.col("obs").cast("string"), "part").alias("id"), "text", "x", "y", "w", "h")


def fields(spark, sf_dir):
    made = F.broadcast(spark.createDataFrame(list(FIELDS), "kind int, tag string, type string, input_type string, autocomplete string, maxlength int, label_raw string, placeholder_raw string"))
    each = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.pmod("page_id", F.lit(len(FIELDS))).cast("int").alias("kind"))
    return each.join(made, "kind")


def ctx_inline(spark, sf_dir):
    return context.inline(nodes(spark, sf_dir))


def ctx_adjacent(spark, sf_dir):
    return context.adjacent(nodes(spark, sf_dir))


def ctx_table(spark, sf_dir):
    return context.table(nodes(spark, sf_dir))


def ctx_all(spark, sf_dir):
    return context.hits(nodes(spark, sf_dir))


def elem_rules(spark, sf_dir):
    return fields(spark, sf_dir).select("page_id", F.posexplode(context.field_rules()).alias("nth", "r")).select("page_id", F.col("nth").cast("long").alias("nth"), "r.*")


def elem_class_pick(spark, sf_dir):
    return fields(spark, sf_dir).select("page_id", context.field_class(context.field_rules()).alias("class"), F.array_join(context.actions(), ",").alias("actions"))


def walk_document(spark, sf_dir):
    got = pages.walk(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    kind = lambda k: F.size(F.filter("elements", lambda e: e["kind"] == k)).cast("long").alias(k)
    return got.select("page_id", kind("interactive"), kind("media"), kind("landmark"), F.size("texts").cast("long").alias("texts"), "truncated")


def collect_text_nodes(spark, sf_dir):
    got = pages.walk(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", F.explode("texts").alias("t")).select("page_id", "t.*")


def page_titles(spark, sf_dir):
    return pages.titles(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (ctx_inline, ctx_adjacent, ctx_table, ctx_all, elem_rules, elem_class_pick, walk_document, collect_text_nodes, page_titles)}
_PLACED = {
    "ctx_inline": ((1, 0, "PHONE", 2, 0.85, "+91 99194 14773"), (1, 2, "EMAIL", 2, 0.85, "a@b.co")),
    "ctx_adjacent": ((0, 1, "PERSON_NAME", 3, 0.85, "Vivek Gupta"), (0, 3, "CITY", 3, 0.85, "Nagpur"), (2, 5, "POSTAL_CODE", 3, 0.85, "440001"), (4, 1, "PAN", 2, 0.85, "abcde1234f")),
    "ctx_table": ((3, 3, "PERSON_NAME", 3, 0.8, "Asha Rao"), (3, 6, "PERSON_NAME", 3, 0.8, "Ravi Das"), (3, 4, "MRN", 2, 0.8, "MR-1001"), (3, 7, "MRN", 2, 0.8, "MR-1002"), (3, 5, "PHONE", 2, 0.8, "98765 43210"), (3, 8, "PHONE", 2, 0.8, "91234 56780")),
}
_PLACED["ctx_all"] = tuple(x for v in list(_PLACED.values()) for x in v)


def _sql(hits) -> str:
    """What the operators must find, told hit by hit."""
    rows = ", ".join(f"({k}, '{k}-{i}', '{t}', {tier}, {c}::DOUBLE, '{v}')" for k, i, t, tier, c, v in hits)
    return f"SELECT page_id AS obs, page_id || '-' || part AS id, type, tier, confidence, value FROM pages JOIN (VALUES {rows}) AS h(kind, part, type, tier, confidence, value) ON page_id % {len(NODES)} = kind"


ORACLES = {k: _sql(v) for k, v in _PLACED.items()} | {
    "page_titles": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS n_links FROM pages",
}
