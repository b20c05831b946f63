"""Failing sources over the driver's pages: text blocks of their markup are what the page's text shows, links are pictures that only a reader of pixels reads. A page has one block and one picture
of test vectors beside its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import chaos as C, geometry as G, recognize
from siftwork.plans.probes import VECTORS, found_sql, q
from siftwork.tables import cut

QUERIES, ORACLES = {}, {}
TEXT, PICTURE, NAME = "<(?:p|h1|div|b)>([^<]+)", "<a [^>]*>([^<]+)", "[A-Z][a-z]{8,}"
KINDS = ("email", "card", "ipv4")
PII = {"EMAIL": "EMAIL", "CARD": "CREDIT_CARD", "IP": "IP"}
VISION_CHARS = 12
#: Of a block.
WIDTH = 320


def blocks(spark, sf_dir: str) -> DataFrame:
    """(obs, ord, picture, text, rect): texts in the left column, pictures in the right one."""
    lines = F.array(*map(F.lit, VECTORS))
    line = lambda n: F.get(lines, F.pmod(F.col("page_id") + n, F.lit(len(VECTORS))).cast("int"))
    of = lambda pattern, n: F.concat(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.array(line(n)))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("obs"), F.posexplode(F.concat(F.transform(of(TEXT, 0), lambda t: F.struct(F.lit(False).alias("picture"), t.alias("text"))), F.transform(of(PICTURE, 5), lambda t: F.struct(F.lit(True).alias("picture"), t.alias("text"))))).alias("ord", "b"))
    rect = G.rect(F.when(F.col("b.picture"), 640).otherwise(0), F.col("ord") * 48, F.lit(WIDTH), F.lit(40))
    return rows.select("obs", "ord", "b.picture", "b.text", rect.alias("rect"))


def _scene(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks, evidence, coverage and truth."""
    pii = lambda s: F.coalesce(*[F.when(s["type"] == k, v) for k, v in PII.items()])
    # one pass over the texts; what they hold is all that is kept of them
    seen = F.transform(recognize.recognize(F.col("text"), KINDS), lambda s: F.struct(pii(s).alias("pii_type"), s["confidence"].alias("confidence")))
    words = F.when(F.col("picture"), 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))))
    b = cut(blocks(spark, sf_dir).select("obs", "ord", "picture", "rect", seen.alias("seen"), words.alias("n_names"), (F.trim("text") != "").alias("shown"), (F.col("picture") & (F.length("text") >= VISION_CHARS)).alias("boxed")), "chaos-blocks")
    number = lambda nth: F.col("ord").cast("long") * 1_000_000 + nth if isinstance(nth, int) else F.col("ord").cast("long") * 1_000_000 + F.col(nth)
    values = b.select("obs", "ord", "picture", "rect", F.posexplode("seen").alias("nth", "s"))
    values = values.select("obs", "ord", "picture", "rect", F.concat_ws(":", "ord", "nth").alias("vid"), number("nth").alias("n"), "s.pii_type", "s.confidence")
    names = b.where("n_names > 0").select("obs", "ord", "rect", F.explode(F.sequence(F.lit(0), F.col("n_names") - 1)).alias("nth"))
    source = F.when(F.col("picture"), "ocr").otherwise("dom")
    found = values.select("obs", source.alias("source"), F.when(F.col("picture"), "ocr").otherwise("regex").alias("type"), "pii_type", "confidence", "rect", (F.col("n") * 3).alias("ord"))
    named = names.select("obs", F.lit("ner").alias("source"), F.lit("ner").alias("type"), F.lit("PERSON_NAME").alias("pii_type"), F.lit(0.9).alias("confidence"), "rect", (number("nth") * 3 + 1).alias("ord"))
    boxes = b.where("boxed").select("obs", F.lit("vision").alias("source"), F.lit("vision").alias("type"), F.lit("PERSONAL").alias("pii_type"), F.lit(0.4).alias("confidence"), "rect", (number(0) * 3 + 2).alias("ord"))
    evidence = found.unionByName(named).unionByName(boxes)
    answers = F.explode(F.when(F.col("picture"), F.array(F.lit("ocr"), F.lit("vision"))).otherwise(F.array(F.lit("ner"))))
    coverage = b.where("shown").select("obs", "ord", "rect", answers.alias("source")).withColumn("reason", F.concat("source", F.lit("_unavailable")))
    tier = F.when(F.col("pii_type") == "CREDIT_CARD", 1).otherwise(2)
    truth = values.select("obs", F.concat(F.lit("v"), "vid").alias("vid"), tier.alias("tier"), "rect", (~F.col("picture")).alias("readable")).unionByName(names.select("obs", F.concat_ws(":", F.lit("n"), "ord", "nth").alias("vid"), F.lit(3).alias("tier"), "rect", F.lit(True).alias("readable")))
    return b, evidence, coverage, truth


def chaos(spark, sf_dir: str) -> DataFrame:
    """A row for each page, profile and setting."""
    return C.run_all(*_scene(spark, sf_dir), ("STRICT", "BALANCED"), WIDTH).withColumnRenamed("obs", "page_id")


def chaos_summary(spark, sf_dir: str) -> DataFrame:
    """The same over all pages, by setting, strict."""
    return C.summary(C.run_all(*_scene(spark, sf_dir), ("STRICT",), WIDTH))


def _sql(profiles: tuple[str, ...]) -> str:
    """Common tables that end in out(page_id, profile, setting, label, ...): blocks don't meet one another, so each block's score is a product over its own evidence."""
    p = schema.PROFILES["STRICT"]
    lines = f"[{', '.join(map(q, VECTORS))}]"
    block = lambda pattern, n: f"list_append(regexp_extract_all(html, {q(pattern)}, 1), {lines}[((page_id + {n}) % {len(VECTORS)} + 1)::INTEGER])"
    values = " UNION ALL ".join(f"SELECT doc_id, type, confidence FROM {k}" for k in KINDS)
    states = ", ".join(f"({s})" for s in C.STATES)
    subsets = [(m, "+".join(x for k, x in enumerate(C.SOURCES) if m >> k & 1)) for m in range(1, 8)]
    settings = ["(0, 'healthy', 'none', '', 0)"] + [f"({1 + k * 7 + m - 1}, '{names} {mode}', '{mode}', '{'' if mode == 'silent' else names}', {m + (8 if mode == 'silent' else 0)})" for k, mode in enumerate(C.MODES) for m, names in subsets]
    limits = ", ".join(f"('{n}', {schema.PROFILES[n]['unexplained_prior']}, {schema.PROFILES[n]['tokenize']})" for n in profiles)
    return f"""WITH t AS (SELECT page_id, {block(TEXT, 0)} AS a, {block(PICTURE, 5)} AS b FROM pages),
u AS (SELECT page_id, list_concat(a, b) AS x, len(a) AS n FROM t),
w AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS i, x, n FROM u),
probe AS (SELECT page_id * 100000 + i AS doc_id, page_id, i > n AS picture, x[i] AS text FROM w),
{', '.join(map(found_sql, KINDS))},
v AS (SELECT doc_id, count(*) AS n, count(*) FILTER (type = 'CARD') AS n_card, product(1 - confidence) AS seen, product(1 - {p['ocr']} * confidence) AS read FROM ({values}) GROUP BY 1),
e AS (SELECT p.doc_id, p.page_id, p.picture, coalesce(v.n, 0) AS n, coalesce(v.n_card, 0) AS n_card, trim(p.text, ' ') <> '' AS shown,
    CASE WHEN p.picture THEN 0 ELSE len(regexp_extract_all(p.text, {q(NAME)})) END AS n_name, coalesce(CASE WHEN p.picture THEN v.read ELSE v.seen END, 1) AS clear, p.picture AND length(p.text) >= {VISION_CHARS} AS boxed
  FROM probe p LEFT JOIN v USING (doc_id)),
s(state) AS (VALUES {states}), l(profile, prior, least) AS (VALUES {limits}),
f AS (SELECT *, state & 1 > 0 AS no_ner, state & 2 > 0 AS no_ocr, state & 4 > 0 AS no_vision, state >= 8 AS unseen FROM e, s, l),
g AS (SELECT *, n > 0 AND NOT (picture AND no_ocr) AS has_value, n_name > 0 AND NOT no_ner AS has_name, boxed AND NOT no_vision AS has_box,
    NOT unseen AND shown AND CASE WHEN picture THEN no_ocr OR no_vision ELSE no_ner END AS odd FROM f),
h AS (SELECT *, 1 - CASE WHEN has_value THEN clear ELSE 1 END * CASE WHEN has_name THEN (1 - {p['ner']} * 0.9) ** n_name ELSE 1 END * CASE WHEN has_box THEN 1 - {p['vision']} * 0.4 ELSE 1 END * CASE WHEN odd THEN 1 - prior ELSE 1 END AS score FROM g),
r AS (SELECT *, (has_value OR has_name OR has_box OR odd) AND ((has_value AND n_card > 0) OR score >= least) AS hidden FROM h),
c AS (SELECT page_id, profile, state, count(*) FILTER (hidden) AS redactions, sum(CASE WHEN hidden THEN 0 ELSE n + n_name END) AS missed, sum(CASE WHEN hidden OR picture THEN 0 ELSE n + n_name END) AS leaked,
    sum(CASE WHEN hidden OR picture THEN 0 ELSE n_card END) AS tier1_exposed FROM r GROUP BY ALL),
o(setting, label, mode, degraded, state) AS (VALUES {', '.join(settings)}),
out AS (SELECT c.page_id, c.profile, o.setting::INTEGER AS setting, o.label, o.mode, o.degraded, c.redactions::BIGINT AS redactions, c.missed::BIGINT AS missed, c.leaked::BIGINT AS leaked, c.tier1_exposed::BIGINT AS tier1_exposed,
    c.leaked > z.leaked AS leaks_more, c.redactions < z.redactions AS redacts_less FROM c JOIN o USING (state) JOIN c z ON z.page_id = c.page_id AND z.profile = c.profile AND z.state = 0)"""


QUERIES |= {"chaos": chaos, "chaos_summary": chaos_summary}
ORACLES["chaos"] = f"{_sql(('STRICT', 'BALANCED'))} SELECT * FROM out"
ORACLES["chaos_summary"] = f"{_sql(('STRICT',))} SELECT setting, label, count(*)::BIGINT AS pages, sum(redactions)::BIGINT AS redactions, sum(missed)::BIGINT AS missed, sum(leaked)::BIGINT AS leaked, sum(tier1_exposed)::BIGINT AS tier1_exposed, count(*) FILTER (leaks_more)::BIGINT AS leaking_more, count(*) FILTER (redacts_less)::BIGINT AS redacting_less FROM out GROUP BY 1, 2"
