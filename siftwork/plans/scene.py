"""Queries of layout, classes, bindings and small reshapes over the driver's tables, and their SQL twins.

Elements, texts and frames of a page are line items whose place follows from their keys (see relational.rects); what they are does, too.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema
from siftwork.functions import checks
from siftwork.functions import text as T
from siftwork.operators import fusion, geometry as G, intervals, layout, metrics, session, sessions
from siftwork.plans.probes import _D, _P, q
from siftwork.plans.relational import R, _BOTH, _MEET, _SEGMENT, _pick, _union_sql, read, rects

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def pick(names, by):
    return F.get(F.array(*map(F.lit, names)), F.pmod(by, F.lit(len(names))).cast("int"))


TAGS = ("input", "div", "button", "canvas", "a", "select", "img", "textarea")
INPUTS = ("text", "email", "password", "search", "tel", "number")
TOKENS = ("", "cc-number", "email", "street-address", "name", "bday", "tel")
ROLES = ("textbox", "heading", "searchbox", "button", "link")
TYPES = ("EMAIL", "PASSWORD", "CARD", "CITY", "NAME", "BDAY", "card", "SECRET", "", "NOBODY")
STATES = ("10", "20", "40", "80")


def elements(spark, sf_dir):
    i = F.col("id")
    rows = rects(spark, sf_dir).where("side = 0").select(
        "obs", "id", i.alias("ord"), "rect", pick(TAGS, F.floor(i / 10)).alias("tag"), pick(INPUTS, F.floor(i / 1000)).alias("type"), pick(TOKENS, F.floor(i / 1000)).alias("autocomplete"), pick(ROLES, F.floor(i / 10)).alias("role"),
        (i % 5 != 0).alias("visible"), (i % 7 != 0).alias("enabled"), (i % 11 == 0).alias("unexplained"), F.when(i % 3 == 0, F.concat(F.lit("Name "), (i % 13).cast("string"))).otherwise("").alias("label_raw"),
    )
    return rows


def texts(spark, sf_dir):
    return rects(spark, sf_dir).where("side = 1 AND id % 3 = 0").select("obs", "id", F.col("id").alias("ord"), "rect")


def frames(spark, sf_dir):
    return rects(spark, sf_dir).where("side = 1 AND id % 3 = 1").select("obs", "id", F.col("id").alias("ord"), "rect", F.when(F.col("id") % 4 == 1, "cross").otherwise("same").alias("origin"))


_I = lambda n: f"id // {n}"
EL = f"""{R}, el AS (SELECT obs, id, x, y, w, h, {_pick(TAGS, _I(10))} AS tag, {_pick(INPUTS, _I(1000))} AS type, {_pick(TOKENS, _I(1000))} AS autocomplete, {_pick(ROLES, _I(10))} AS role, id % 5 <> 0 AS visible, id % 7 <> 0 AS enabled,
  id % 11 = 0 AS unexplained, CASE WHEN id % 3 = 0 THEN 'Name ' || id % 13 ELSE '' END AS label_raw FROM r WHERE id % 2 = 0), tx AS (SELECT obs, id, x, y, w, h FROM r WHERE id % 2 = 1 AND id % 3 = 0),
fr AS (SELECT obs, id, x, y, w, h, CASE WHEN id % 4 = 1 THEN 'cross' ELSE 'same' END AS origin FROM r WHERE id % 2 = 1 AND id % 3 = 1)"""
_OPAQUE = ", ".join(map(q, schema.OPAQUE_TAGS))


# ---- layout
@query(f"WITH {R} SELECT obs, id, x + w / 2 AS cx, y + h / 2 AS cy, greatest(0, least(x, 1280 - w)) AS kx, greatest(0, least(y, 720 - h)) AS ky, least(w, 1280) AS kw, least(h, 720) AS kh FROM r")
def geo_clamp(spark, sf_dir):
    """Centres, and rectangles moved into a viewport of 1280 by 720."""
    k, c = G.clamp(F.col("rect"), G.rect(F.lit(0), F.lit(0), F.lit(1280), F.lit(720))), G.center(F.col("rect"))
    return rects(spark, sf_dir).select("obs", "id", c["x"].alias("cx"), c["y"].alias("cy"), *[k[a].alias(f"k{a}") for a in "xywh"])


_CROP = "c AS (SELECT *, greatest(0, least(x, 799)) AS cx, greatest(0, least(y, 599)) AS cy FROM r), d AS (SELECT *, greatest(1, least(w * 9, 800 - cx)) AS cw, greatest(1, least(h * 9, 600 - cy)) AS ch FROM c), e AS (SELECT *, least(1, 512 / greatest(cw, ch)) AS s FROM d)"


@query(f"WITH {R}, {_CROP} SELECT obs, id, cx, cy, cw, ch, round(s, 9) AS scale, greatest(1, floor(cw * s + 0.5))::BIGINT AS width, greatest(1, floor(ch * s + 0.5))::BIGINT AS height, round(cx + 3 / s, 6) AS bx, round(cy + 5 / s, 6) AS by, round(7 / s, 6) AS bw, round(11 / s, 6) AS bh FROM e")
def crop_geometry(spark, sf_dir):
    """Crops of large regions in a viewport of 800 by 600, and a box in each crop back in the viewport."""
    r = F.col("rect")
    rows = rects(spark, sf_dir).withColumn("c", layout.crop_geometry(G.rect(r["x"], r["y"], r["w"] * 9, r["h"] * 9), 800, 600))
    box = F.struct(F.lit(3.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(16.0).alias("y1"))
    b = layout.box_to_viewport(box, F.col("c"))
    return rows.select("obs", "id", *[F.col("c.rect")[a].alias(f"c{a}") for a in "xywh"], F.round("c.scale", 9).alias("scale"), "c.width", "c.height", *[F.round(b[a], 6).alias(f"b{a}") for a in "xywh"])


_HALF = lambda v: f"floor({v} + 0.5)"


@query(f"WITH {R}, p AS (SELECT *, 1 + id % 4 * 0.25 AS d, CASE WHEN greatest(w, h) * 12 <= 640 THEN 1 ELSE 640 / (greatest(w, h) * 12) END AS s FROM r) SELECT obs, id, " + ", ".join(f"{_HALF(f'{a} * d')} AS b{a}, {_HALF(f'{a} / d')} AS c{a}, {_HALF(_HALF(f'{a} * d') + ' * s')} AS s{a}, {_HALF(f'{a} / s / d')} AS u{a}" for a in "xywh") + ", round(s, 9) AS scale, floor(w * 12 * s + 0.5)::BIGINT AS width FROM p")
def dpr_math(spark, sf_dir):
    """Rectangles through device pixels and downscaled pictures, either way."""
    r, d = F.col("rect"), 1 + F.col("id") % 4 * 0.25
    rows = rects(spark, sf_dir).withColumn("d", d.cast("double")).withColumn("s", layout.scale_factor(r["w"] * 12, r["h"] * 12))
    d, s = F.col("d"), F.col("s")
    made = {"b": layout.to_bitmap(r, d), "c": layout.from_bitmap(r, d), "s": layout.to_downscaled(r, d, s), "u": layout.from_downscaled(r, d, s)}
    return rows.select("obs", "id", *[c[a].alias(k + a) for k, c in made.items() for a in "xywh"], F.round("s", 9).alias("scale"), layout.half_up(r["w"] * 12 * s).alias("width"))


@query(f"WITH {R} SELECT obs, id, x - 600 + w >= -50 AND y - 400 + h >= -50 AND x - 600 <= 450 AND y - 400 <= 350 AS inside FROM r")
def in_viewport(spark, sf_dir):
    r = F.col("rect")
    return rects(spark, sf_dir).select("obs", "id", layout.in_viewport(G.rect(r["x"] - 600, r["y"] - 400, r["w"], r["h"]), 400, 300).alias("inside"))


_FOUND = f"""f AS (SELECT obs, 0 AS phase, id, x, y, w, h, CASE WHEN unexplained THEN 'unexplained_element' WHEN tag IN ({_OPAQUE}) THEN 'opaque_' || tag END AS reason, least(1, 0.3 + CASE WHEN tag = 'canvas' THEN 0.3 WHEN tag IN ('img', 'svg') THEN 0.2 ELSE 0 END
  + CASE WHEN type = 'password' THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(autocomplete, 'address|name|email|tel|cc-') THEN 0.2 ELSE 0 END) AS suspicion FROM el WHERE visible UNION ALL SELECT obs, 1, id, x, y, w, h, 'cross_origin_iframe', 0.9 FROM fr WHERE origin = 'cross'),
u AS (SELECT * FROM f WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs, x, y, w, h ORDER BY phase, id) = 1)"""


@query(f"WITH {EL}, {_FOUND} SELECT obs, id AS ord, reason, w * h AS area, round(suspicion, 6) AS suspicion FROM u")
def crop_find(spark, sf_dir):
    return layout.unexplained_regions(elements(spark, sf_dir), frames(spark, sf_dir)).select("obs", "ord", "reason", "area", F.round("suspicion", 6).alias("suspicion"))


@query(f"WITH {EL}, {_FOUND} SELECT DISTINCT obs, CASE WHEN obs IN (SELECT obs FROM u) THEN NULL ELSE 'no_unexplained_crops' END AS reason FROM r")
def ocr_skip(spark, sf_dir):
    found = layout.unexplained_regions(elements(spark, sf_dir), frames(spark, sf_dir))
    return layout.ocr_skip(rects(spark, sf_dir).select("obs").distinct(), found)


@query(f"""WITH {EL}, s AS (SELECT * FROM el WHERE visible) SELECT obs, 'e' || id AS part, CASE WHEN unexplained THEN 'unexplained <' || tag || '> region' WHEN tag IN ({_OPAQUE}) THEN 'opaque <' || tag || '>, contents unreadable from the DOM' END AS reason FROM s WHERE unexplained OR tag IN ({_OPAQUE}) OR id % 6 <> 0
UNION ALL SELECT obs, 'f' || id, 'cross-origin iframe' FROM fr WHERE origin = 'cross' UNION ALL SELECT obs, 't' || id, NULL FROM tx""")
def partition_explained(spark, sf_dir):
    """Parts of pages with a reason to look closer, and, with none, those that explain others."""
    el = elements(spark, sf_dir)
    candidates, explained = layout.partition_explained(el, texts(spark, sf_dir), frames(spark, sf_dir), el.where("id % 6 = 0").select("obs", "id"))
    return candidates.select("obs", F.col("id").alias("part"), "reason").unionByName(explained.select("obs", F.col("eid").alias("part"), F.lit(None).cast("string").alias("reason")))


@query(f"""WITH {EL}, c AS (SELECT obs, id, x, y, w, h, CASE WHEN unexplained THEN 'unexplained <' || tag || '> region' ELSE 'opaque <' || tag || '>, contents unreadable from the DOM' END AS reason FROM el WHERE visible AND (unexplained OR tag IN ({_OPAQUE}))),
o AS (SELECT obs, 'e' || id AS id, x, y, w, h FROM el WHERE visible AND NOT unexplained AND tag NOT IN ({_OPAQUE}) UNION ALL SELECT obs, 't' || id, x, y, w, h FROM tx),
m AS (SELECT a.obs, a.id, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS h, row_number() OVER (PARTITION BY a.obs, a.id ORDER BY {_BOTH} DESC, b.id) AS nth FROM c a JOIN o b ON a.obs = b.obs AND {_MEET}),
k AS (SELECT * FROM m WHERE nth <= {fusion.OWNERS}), {_union_sql('k', 'id')} SELECT c.obs, c.id, reason || CASE WHEN coalesce(area, 0) = 0 THEN ', no DOM owner' ELSE ', only ' || round(area / (w * h) * 100, 0)::BIGINT || '% owned by the DOM' END AS reason, round(coalesce(area, 0) / (w * h), 6) AS coverage FROM c LEFT JOIN areas ON c.id = areas.id WHERE coalesce(area, 0) / (w * h) < 0.98""")
def explain_regions(spark, sf_dir):
    """Opaque elements that the others explain less than a strict policy asks for."""
    el = elements(spark, sf_dir)
    candidates, explained = layout.partition_explained(el, texts(spark, sf_dir), frames(spark, sf_dir).limit(0), el.limit(0).select("obs", "id"))
    out = fusion.explain_or_redact(candidates, explained, schema.PROFILES["STRICT"]["min_coverage"])
    return out.select("obs", F.regexp_replace("id", "^e", "").cast("long").alias("id"), "reason", F.round("coverage", 6).alias("coverage"))


_FNV = "lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT), 36))"


@query(f"WITH {EL}, s AS (SELECT obs, id, tag || '|' || role || '|' || lower(trim(label_raw)) || '|div > ' || tag || '|' || (floor(x / 4 + 0.5) * 4)::BIGINT || ',' || (floor(y / 4 + 0.5) * 4)::BIGINT || ',' || (floor(w / 4 + 0.5) * 4)::BIGINT || ',' || (floor(h / 4 + 0.5) * 4)::BIGINT || '|0' AS s FROM el) SELECT obs, id, {_FNV.format('s')} AS hash FROM s")
def identity_hash(spark, sf_dir):
    path = F.concat(F.lit("div > "), "tag")
    return elements(spark, sf_dir).select("obs", "id", checks.identity_hash(F.col("tag"), F.col("role"), F.col("label_raw"), path, F.col("rect"), F.lit(0)).alias("hash"))


@query(f"WITH {EL} SELECT obs, id, CASE WHEN type = 'password' OR regexp_matches(autocomplete, 'cc-|password|one-time-code') THEN 'PASSWORD' WHEN type = 'email' OR contains(autocomplete, 'email') THEN 'EMAIL' WHEN type = 'tel' OR contains(autocomplete, 'tel') THEN 'PHONE' WHEN regexp_matches(autocomplete, 'address|street|postal') THEN 'ADDRESS' WHEN contains(autocomplete, 'name') OR (role = 'heading' AND contains(lower(label_raw), 'name')) THEN 'NAME' WHEN regexp_matches(autocomplete, 'bday|birth') THEN 'PERSONAL' WHEN type = 'search' OR role = 'searchbox' THEN 'NONE' END AS class FROM el")
def elem_class_fallback(spark, sf_dir):
    return elements(spark, sf_dir).select("obs", "id", layout.class_fallback().alias("class"))


_BUTTONS = ", ".join(map(q, schema.STATELESS_TYPES))
CONTROLS = ("text", "checkbox", "radio", "submit", "range", "email")


@query(f"""WITH {EL}, c AS (SELECT *, {_pick(CONTROLS, 'id // 1000')} AS kind, id % 4 < 2 AS checked, CASE WHEN id % 3 = 0 THEN 'hint' END AS placeholder, id % 9 = 4 AS required, CASE WHEN id % 8 < 4 THEN 'v' ELSE '' END AS value, id // 10 % 4 - 1 AS selected, CASE WHEN id % 16 < 8 THEN '' ELSE 'o' END AS option_value FROM el)
SELECT obs, id, CASE WHEN tag = 'input' THEN CASE WHEN kind IN ({_BUTTONS}) THEN 'n/a' WHEN kind IN ('checkbox', 'radio') THEN CASE WHEN checked THEN 'filled' ELSE 'empty' END WHEN placeholder IS NOT NULL OR required THEN CASE WHEN value = '' THEN 'empty' ELSE 'filled' END ELSE 'n/a' END
  WHEN tag = 'textarea' THEN CASE WHEN value = '' THEN 'empty' ELSE 'filled' END WHEN tag = 'select' THEN CASE WHEN selected < 0 OR option_value = '' THEN 'empty' ELSE 'filled' END ELSE 'n/a' END AS state FROM c""")
def cast_status(spark, sf_dir):
    """Whether controls hold something, told without their values."""
    i = F.col("id")
    rows = elements(spark, sf_dir).select(
        "obs", "id", "tag", pick(CONTROLS, F.floor(i / 1000)).alias("type"), (i % 4 < 2).alias("checked"), F.when(i % 3 == 0, "hint").alias("placeholder"), (i % 9 == 4).alias("required"),
        F.when(i % 8 < 4, "v").otherwise("").alias("value"), (F.floor(i / 10) % 4 - 1).alias("selected"), F.when(i % 16 < 8, "").otherwise("o").alias("option_value"),
    )
    return rows.select("obs", "id", layout.value_state().alias("state"))


_COUNT = lambda p: f"len(regexp_extract_all(coalesce(html, ''), {q(p)}))"
_MARKUP = {"passwords": "<input[^>]*type=.?password", "inputs": "<(input|textarea|select)[ />]", "links": "<a ", "lists": "<(table|ul|ol)[ >]"}


@query(f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path, regexp_extract(url, '([?][^#]*)', 1) AS query, lower(regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1)) AS title, {', '.join(f'{_COUNT(p)} AS {n}' for n, p in _MARKUP.items())} FROM pages)
SELECT page_id, CASE WHEN passwords > 0 THEN 'auth' WHEN regexp_matches(path || ' ' || title, 'checkout|payment|shipping') THEN 'checkout' WHEN regexp_matches(path || ' ' || query, 'search|results|\\?q=') THEN 'search' WHEN inputs >= 3 THEN 'form' WHEN lists >= 2 AND links > 8 THEN 'list' WHEN regexp_matches(path, 'product|item|order|patient|detail') THEN 'detail' ELSE 'other' END AS type FROM p""")
def page_classify(spark, sf_dir):
    """What pages are for, by patterns over their markup."""
    html = F.coalesce("html", F.lit(""))
    counts = [F.regexp_count(html, F.lit(p)) for p in _MARKUP.values()]
    made = layout.page_type(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract("url", "([?][^#]*)", 1), F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1), *counts)
    return read(spark, sf_dir, "pages").select("page_id", made.alias("type"))


# ---- classes and bindings
_KINDS = [k for k in sorted(set(schema.TIERS) - set(schema.ALIASES) | {"PERSONAL", "NONE", "USERNAME", "API_KEY", "TOKEN", "SSN", "FINANCIAL", "HEALTH"})]
_NORM = lambda c: f"(CASE WHEN {c} = '' THEN 'NONE' ELSE (SELECT CASE WHEN a IN ({', '.join(map(q, _KINDS))}) THEN a ELSE 'PERSONAL' END FROM (SELECT CASE upper({c}) {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in schema.ALIASES.items())} ELSE upper({c}) END AS a)) END)"


@query(f"WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, {_pick(TYPES, 'l_orderkey // 3 + l_linenumber')} AS t FROM lineitem) SELECT l_orderkey, l_linenumber, {_NORM('t')} AS type FROM t")
def pii_type_norm(spark, sf_dir):
    t = pick(TYPES, F.floor(F.col("l_orderkey") / 3) + F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", session.norm_type(t).alias("type")).distinct()


HANDLES = ("⟦EMAIL#3⟧", "⟦PASSWORD⟧", "⟦CITY#12⟧", "EMAIL#3", "⟦⟧", "a ⟦CARD#1⟧ b")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(h, '⟦[^#⟧]+[#⟧]') THEN regexp_extract(h, '⟦([^#⟧]+)[#⟧]', 1) ELSE 'NONE' END AS kind FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_pick(HANDLES, 'l_orderkey // 3 + l_linenumber')} AS h FROM lineitem)")
def handle_parse(spark, sf_dir):
    h = pick(HANDLES, F.floor(F.col("l_orderkey") / 3) + F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", session.handle_kind(h).alias("kind")).distinct()


FIELDS = ("", "EMAIL", "CREDIT_CARD", "ADDRESS", "PASSWORD", "NONE")
VALUES = ("EMAIL", "CARD", "CITY", "SECRET", "NAME", "PASSWORD", "BDAY")
_ALLOWED = f"CASE WHEN f IN ('', 'NONE') THEN t IN ({', '.join(map(q, schema.FREE_TEXT_ACCEPTS))}) ELSE (SELECT list_contains(CASE t {' '.join(f'WHEN {q(k)} THEN [{', '.join(map(q, v))}]' for k, v in schema.ACCEPTED.items())} ELSE [t] END, {_NORM('f')})) END"
_BOUND = f"b AS (SELECT DISTINCT l_orderkey, l_linenumber, {_pick(VALUES, 'l_orderkey // 3')} AS v, {_pick(FIELDS, 'l_orderkey // 7 + l_linenumber')} AS f, {_NORM(_pick(VALUES, 'l_orderkey // 3'))} AS t FROM lineitem)"


def _bindings(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick(VALUES, F.floor(o / 3)).alias("v"), pick(FIELDS, F.floor(o / 7) + n).alias("f")).distinct()


@query(f"WITH {_BOUND} SELECT l_orderkey, l_linenumber, {_ALLOWED} AS allowed FROM b")
def binding_allowed(spark, sf_dir):
    """May a value of a type go into a field of a class?"""
    accepts = F.when(F.col("f") == "", F.array().cast("array<string>")).otherwise(F.array("f"))
    return _bindings(spark, sf_dir).select("l_orderkey", "l_linenumber", session.binding_allowed(F.col("v"), accepts).alias("allowed"))


@query(f"WITH {_BOUND} SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 <> 0 AND {_ALLOWED} THEN 'value ' || l_orderkey END AS value, CASE WHEN l_orderkey % 4 = 0 THEN 'HANDLE_NOT_FOUND' WHEN NOT ({_ALLOWED}) THEN 'VAULT_TYPE_MISMATCH' END AS code FROM b")
def resolve_binding(spark, sf_dir):
    """Handles looked up in a vault that holds three of four orders' values."""
    b = _bindings(spark, sf_dir).withColumn("handle", F.col("l_orderkey").cast("string"))
    vault = b.where("l_orderkey % 4 <> 0").select("handle", F.col("v").alias("type"), F.concat(F.lit("value "), "handle").alias("value")).distinct()
    asked = b.select("l_orderkey", "l_linenumber", "handle", F.when(F.col("f") == "", F.array().cast("array<string>")).otherwise(F.array("f")).alias("accepts"))
    return session.resolve(asked, vault).select("l_orderkey", "l_linenumber", "value", "code")


# ---- reshapes
@query("""WITH o AS (SELECT l_orderkey, l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem)
SELECT l_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' AND n = 0 THEN 'p' || l_partkey END), '') AS a, coalesce(max(CASE WHEN l_returnflag = 'N' AND n = 2 THEN 'p' || l_partkey END), max(CASE WHEN l_returnflag = 'N' AND n = 0 THEN 'p' || l_partkey END), '') AS third FROM o GROUP BY 1""")
def nth_of_type(spark, sf_dir):
    """Of each order the first returned part and the third open one, or its first."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_linenumber", "l_partkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("v"))
    return layout.firsts_of_kind(li, "l_orderkey", "l_returnflag", "o", "v", {"a": ("A", 0), "third": ("N", 2)}, fallback=True)


@query("""WITH o AS (SELECT l_orderkey, l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem),
w AS (SELECT l_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' AND n = 0 THEN 'p' || l_partkey END), '') AS first, coalesce(max(CASE WHEN l_returnflag = 'N' AND n = 1 THEN 'p' || l_partkey END), '') AS second FROM o GROUP BY 1)
SELECT l_orderkey, first, second, 'to ' || first || ', ' || second || '; ' AS said FROM w""")
def persona_fields(spark, sf_dir):
    """Fields by kind and place, missing ones empty, put into a template with an unknown name."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_linenumber", "l_partkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("v"))
    wide = layout.firsts_of_kind(li, "l_orderkey", "l_returnflag", "o", "v", {"first": ("A", 0), "second": ("N", 1)}, fallback=False)
    return wide.withColumn("said", T.fill(F.lit("to $person.first, $person.second; $person.nobody"), F.create_map(F.lit("first"), "first", F.lit("second"), "second")))


@query("""WITH o AS (SELECT user_id, event_type AS item, ts, event_id, event_id % 7 = 0 AS sets, event_id % 5 - 1 AS q FROM events), s AS (SELECT user_id, item, max((ts, event_id)) AS at, arg_max(q, (ts, event_id)) AS q FROM o WHERE sets GROUP BY ALL)
SELECT o.user_id, o.item, (greatest(coalesce(any_value(s.q), 0), 0) + count(*) FILTER (NOT sets AND (s.at IS NULL OR (ts, event_id) > s.at)))::BIGINT AS quantity FROM o LEFT JOIN s ON o.user_id = s.user_id AND o.item = s.item GROUP BY ALL HAVING quantity > 0""")
def cart_upsert(spark, sf_dir):
    """Carts after all additions and settings of a quantity; nothing and less deletes."""
    ev = read(spark, sf_dir, "events")
    ops = ev.select("user_id", F.col("event_type").alias("item"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 5 - 1).alias("quantity"))
    return sessions.cart(ops, "user_id", "item", "at", "quantity")


@query("SELECT c_custkey, 'ORD-' || c_custkey || lpad(n::VARCHAR, 3, '0') AS id, 'TRK' || (c_custkey * 7919 + n * 104729) % 100000000 AS tracking, CASE n WHEN 1 THEN 'Delivered' WHEN 2 THEN 'Shipped' ELSE 'Processing' END AS status, epoch_us(TIMESTAMP '2026-08-20' - to_days(CASE n WHEN 1 THEN 12 WHEN 2 THEN 3 ELSE 1 END)) // 1000 AS placed_ms FROM customer, (VALUES (1), (2), (3)) AS t(n)")
def seeded_orders(spark, sf_dir):
    return sessions.seeded_orders(read(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT c_custkey, c_custkey + CASE c_custkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS seed FROM customer")
def patient_seed(spark, sf_dir):
    """Seeds of patients P001 to P003, and of unknown ones."""
    return read(spark, sf_dir, "customer").select("c_custkey", sessions.patient_seed(F.col("c_custkey"), pick(("P001", "P002", "P003", "P004", "x"), F.col("c_custkey"))).alias("seed"))


@query("WITH o AS (SELECT event_type, (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / (count(*) - 1) AS slope, count(*) AS n FROM events GROUP BY 1) SELECT event_type, CASE WHEN n > 1 THEN round(slope, 9) END AS slope FROM o")
def heap_slope(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.slope(F.col("value"), at), 9).alias("slope"))


@query("SELECT user_id, round(sum(value), 6) AS total, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS network, count(*) FILTER (event_type = 'error')::BIGINT AS blocked, count(*)::BIGINT AS steps FROM events GROUP BY 1")
def trace_summary(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)), 6).alias("network"), F.count_if(F.col("event_type") == "error").alias("blocked"), F.count("*").alias("steps"))


@query("WITH b AS (SELECT user_id, min(ts) AS begun FROM events GROUP BY 1) SELECT event_id, epoch_ms(ts) - epoch_ms(begun) > 1800000 AS expired FROM events JOIN b USING (user_id)")
def session_ttl(spark, sf_dir):
    return sessions.expired(read(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "expired")


@query("""WITH o AS (SELECT user_id AS space, 'k' || event_id % 5 AS key, (ts, event_id) AS t, CASE WHEN event_id % 11 = 0 THEN 'clear' WHEN event_id % 6 = 0 THEN 'delete' ELSE 'put' END AS op, 'v' || event_id AS value FROM events), c AS (SELECT space, max(t) AS t FROM o WHERE op = 'clear' GROUP BY 1),
l AS (SELECT o.space, o.key, arg_max(o.op, o.t) AS op, arg_max(o.value, o.t) AS value FROM o LEFT JOIN c ON o.space = c.space WHERE o.op <> 'clear' AND (c.t IS NULL OR o.t > c.t) GROUP BY ALL) SELECT space, key, value FROM l WHERE op = 'put'""")
def vault_ops(spark, sf_dir):
    """What a key-value store holds after puts, deletions and clearings of a namespace."""
    e = F.col("event_id")
    ops = read(spark, sf_dir, "events").select(F.col("user_id").alias("space"), F.concat(F.lit("k"), (e % 5).cast("string")).alias("key"), F.struct("ts", "event_id").alias("at"), F.when(e % 11 == 0, "clear").when(e % 6 == 0, "delete").otherwise("put").alias("op"), F.concat(F.lit("v"), e.cast("string")).alias("value"))
    return sessions.store(ops)


@query("WITH k AS (SELECT user_id, lower(event_type) AS normal, arg_min(event_id, (ts, event_id)) AS first, count(*)::BIGINT AS n FROM events GROUP BY ALL) SELECT user_id, normal, first, n FROM k")
def registry_ops(spark, sf_dir):
    """The first writing of each normalized value of a session stays."""
    ev = read(spark, sf_dir, "events").select("user_id", T.normalize(F.col("event_type")).alias("normal"), F.struct("ts", "event_id").alias("at"), "event_id")
    return ev.groupBy("user_id", "normal").agg(F.min_by("event_id", "at").alias("first"), F.count("*").alias("n"))


# ---- functions
_DIGIT = f"list_reduce(list_prepend(0, list_transform(range(1, 12), lambda i: 100 * (({_P})[(i % 8) * 10 + substr(d, (12 - i)::BIGINT, 1)::INTEGER + 1]) + i)), lambda c, x: (({_D})[((c % 100) * 10 + x // 100 + 1)::INTEGER]))"


@query(f"WITH d AS (SELECT DISTINCT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 11, '0') AS d FROM orders) SELECT o_orderkey, ([0, 4, 3, 2, 1, 5, 6, 7, 8, 9])[({_DIGIT} + 1)::INTEGER] AS verhoeff, ((10 - list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse(d), i, 1)::INTEGER ELSE (substr(reverse(d), i, 1)::INTEGER * 2) % 10 + (substr(reverse(d), i, 1)::INTEGER * 2) // 10 END)) % 10) % 10)::INTEGER AS luhn FROM d")
def check_digits(spark, sf_dir):
    """Verhoeff's and Luhn's digit for eleven digits."""
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 11, "0").alias("d")).distinct()
    return d.select("o_orderkey", checks.verhoeff_digit(F.col("d")).alias("verhoeff"), checks.luhn_digit(F.col("d")).cast("int").alias("luhn"))


@query("SELECT a.p_partkey, greatest(0, 1 - CASE WHEN length(b.p_name) = 0 THEN CASE WHEN length(a.p_name) = 0 THEN 0 ELSE 1 END ELSE round(levenshtein(a.p_name, b.p_name) / length(b.p_name), 9) END) AS accuracy FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def char_accuracy(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(after, "p_partkey").select("p_partkey", metrics.char_accuracy(F.round(metrics.cer(F.col("p_name"), F.col("b")), 9)).alias("accuracy"))


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_partkey % 50 AS a0, l_partkey % 50 + l_linenumber * 3 AS a1, l_orderkey % 60 AS b0, l_orderkey % 60 + 12 AS b1 FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN least(a1, b1) - greatest(a0, b0) <= 0 THEN 0 ELSE (least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) END, 9) AS iou FROM s")
def span_iou(spark, sf_dir):
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(metrics.span_iou(p % 50, p % 50 + n * 3, o % 60, o % 60 + 12), 9).alias("iou")).distinct()


_MERGE = "CASE WHEN len(done) > 0 AND done[-1].t = x[1].t AND x[1].s <= done[-1].e + 1 THEN done[1:-2] || [{'s': done[-1].s, 'e': greatest(done[-1].e, x[1].e), 't': done[-1].t, 'c': greatest(done[-1].c, x[1].c)}] ELSE done || x END"


@query(f"""WITH s AS (SELECT DISTINCT l_orderkey, {{'s': (l_partkey % 40)::INTEGER, 'e': (l_partkey % 40 + l_linenumber)::INTEGER, 't': l_returnflag, 'c': l_discount::DOUBLE}} AS s FROM lineitem), l AS (SELECT l_orderkey, list_transform(list_sort(list(s)), lambda x: [x]) AS l FROM s GROUP BY 1),
m AS (SELECT l_orderkey, unnest(list_reduce(l, lambda done, x: {_MERGE})) AS m FROM l) SELECT l_orderkey, m.s AS "start", m.e AS "end", m.t AS type, m.c AS confidence FROM m""")
def merge_spans(spark, sf_dir):
    start = F.col("l_partkey") % 40
    s = F.struct(start.cast("int").alias("start"), (start + F.col("l_linenumber")).cast("int").alias("end"), F.col("l_returnflag").alias("type"), F.col("l_discount").cast("double").alias("confidence"))
    per = read(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("s")).distinct().groupBy("l_orderkey").agg(F.collect_list("s").alias("s"))
    return per.select("l_orderkey", F.explode(intervals.merge_spans(F.col("s"))).alias("m")).select("l_orderkey", "m.*")


LABELS = ("PER", "loc", "Org", "DATE", "MONEY", "XYZ")


@query(f"SELECT o_orderkey, CASE upper({_pick(LABELS, 'o_orderkey')}) {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in schema.NER_TYPES.items())} ELSE 'PERSONAL' END AS type FROM orders")
def ner_type_map(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", session.ner_type(pick(LABELS, F.col("o_orderkey"))).alias("type"))


@query("SELECT event_id, octet_length(encode('{\"user\":' || user_id || ',\"type\":\"' || event_type || '\",\"tags\":[\"é\",\"' || event_type || '\"]}'))::BIGINT AS bytes FROM events")
def json_bytes(spark, sf_dir):
    """Bytes of events as JSON."""
    body = F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.array(F.lit("é"), "event_type").alias("tags"))
    return read(spark, sf_dir, "events").select("event_id", F.octet_length(F.to_json(body)).cast("long").alias("bytes"))


@query("WITH t AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'so:' || chr(10) || '```json' || chr(10) || '{\"a\": ' || turn || '}' || chr(10) || '``` {\"b\": 1}' WHEN 1 THEN 'x {\"a\": ' || turn || '} y' WHEN 2 THEN 'nothing' ELSE '``` {\"a\": ' || turn || ', ```' END AS t FROM conversations), c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)```(?:json)?\\s*(.*?)```') THEN regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE t END AS c FROM t), j AS (SELECT conv_id, turn, regexp_extract(c, '(?s)([{].*[}])', 1) AS j FROM c) SELECT conv_id, turn, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.a') END AS a FROM j")
def json_extract_fenced(spark, sf_dir):
    """A member of the JSON object in a model's answer, null where there is no valid one."""
    n = F.col("turn").cast("string")
    said = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit('so:\n```json\n{"a": '), n, F.lit('}\n``` {"b": 1}'))).when(F.col("conv_id") % 4 == 1, F.concat(F.lit('x {"a": '), n, F.lit("} y"))).when(F.col("conv_id") % 4 == 2, "nothing").otherwise(F.concat(F.lit('``` {"a": '), n, F.lit(", ```")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_variant_get(T.fenced_json(said), "$.a", "string").alias("a"))
