"""Queries of observations: the driver's pages, walked, laid out on a grid by rank (a browser's layout isn't in the markup) and made safe.

Without twins: the walk can't be told in SQL. Tests compare small observations with worked results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators import geometry as G, layout, observe
from siftwork.plans.scene import EL, elements as scene_elements, query as scene_query, texts as scene_texts
from siftwork.sources import pages
from siftwork.tables import cut

QUERIES, ORACLES = {}, {}
EVIDENCE = "session string, obs long, ord int, source string, type string, pii_type string, confidence double, rect struct<x:double,y:double,w:double,h:double>, value string"
FAILURES = "obs long, ord int, source string, reason string, rect struct<x:double,y:double,w:double,h:double>"


def query(f):
    QUERIES[f.__name__] = f
    return f


def walked(spark, sf_dir) -> DataFrame:
    return pages.walk(spark.read.parquet(f"{sf_dir}/pages.parquet"), hidden=False)


def elements_of(walk: DataFrame) -> DataFrame:
    """Elements of pages; those of one page are a session."""
    at = F.col("e.id")
    rows = walk.select(F.col("page_id").alias("obs"), F.explode("elements").alias("e"))
    rect = G.rect(F.pmod(at, F.lit(3)) * 300, F.floor(at / 3) * 40, F.lit(120), F.lit(32))
    kind = F.col("e.tag")
    return rows.select(
        F.col("obs").cast("string").alias("session"), "obs", at.alias("ord"), F.concat(F.lit("e"), at.cast("string")).alias("id"), kind.alias("tag"), "e.type", F.col("e.type").alias("input_type"), F.coalesce("e.role", "e.tag").alias("role"), "e.autocomplete",
        F.lit(None).cast("int").alias("maxlength"), F.coalesce("e.name", F.lit("")).alias("label_raw"), F.col("e.placeholder").alias("placeholder_raw"), rect.alias("rect"), F.lit(True).alias("visible"), (~F.col("e.disabled")).alias("enabled"), (kind == "iframe").alias("unexplained"),
    )


def texts_of(walk: DataFrame) -> DataFrame:
    at = F.col("t.id")
    rows = walk.select(F.col("page_id").alias("obs"), F.explode("texts").alias("t"))
    rect = G.rect(F.pmod(at, F.lit(4)) * 200, 1000 + F.floor(at / 4) * 24, F.least(F.lit(190), F.length("t.text") * 8), F.lit(20))
    return rows.select(F.col("obs").cast("string").alias("session"), "obs", at.alias("ord"), F.concat(F.lit("t"), at.cast("string")).alias("id"), "t.text", rect.alias("rect"))


def frames_of(walk: DataFrame) -> DataFrame:
    rows = walk.select(F.col("page_id").alias("obs"), F.explode(F.filter("elements", lambda e: e["tag"] == "iframe")).alias("e"))
    return rows.select("obs", F.col("e.id").alias("ord"), F.col("e.id").alias("id"), G.rect(F.lit(0), F.col("e.id") * 40, F.lit(400), F.lit(40)).alias("rect"), F.when(F.col("e.target").rlike("^https?://"), "cross").otherwise("same").alias("origin"))


#: Words that stand for a name, as a model of names would tell.
NAME = "[A-Z][a-z]{8,}"


def evidence_of(texts: DataFrame) -> DataFrame:
    """What a model of names says of text nodes: each node's names, in order."""
    found = texts.select("session", "obs", "ord", "rect", F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("nth", "value"))
    return found.select("session", "obs", (F.col("ord") * 1000 + F.col("nth")).cast("int").alias("ord"), F.lit("names").alias("source"), F.lit("ner").alias("type"), F.lit("PERSON_NAME").alias("pii_type"), F.lit(0.9).alias("confidence"), "rect", "value")


def failures_of(texts: DataFrame) -> DataFrame:
    """A reader of pixels that failed on pages with many text nodes: on the last of them."""
    last = texts.groupBy("obs").agg(F.max_by("rect", "ord").alias("rect"), F.count("*").alias("n")).where("n >= 20")
    return last.select("obs", F.lit(0).alias("ord"), F.lit("ocr").alias("source"), F.lit("ocr_unavailable").alias("reason"), "rect")


def sanitized(spark, sf_dir, w: DataFrame | None = None) -> observe.Sanitized:
    """w: the walk of the pages as a table, where the caller reads it, too."""
    w = cut(walked(spark, sf_dir), "walked") if w is None else w
    texts = texts_of(w)
    return observe.sanitize(elements_of(w), texts, frames_of(w), evidence_of(texts), failures_of(texts), "BALANCED")


@query
def rec_observation(spark, sf_dir):
    w = walked(spark, sf_dir)
    return observe.rec_observation(elements_of(w), texts_of(w)).select("obs", "at.phase", "at.node", "at.part", "at.nth", "kind", "id", "type", "tier", "confidence", "value")


@query
def sanitize(spark, sf_dir):
    """Texts of pages as they may be sent."""
    return sanitized(spark, sf_dir).texts.select("obs", "id", "text", "rect")


@query
def sanitize_elements(spark, sf_dir):
    return sanitized(spark, sf_dir).elements.drop("session")


@query
def redact_list(spark, sf_dir):
    return sanitized(spark, sf_dir).redactions


@query
def build_observation(spark, sf_dir):
    made = sanitized(spark, sf_dir)
    titles = pages.titles(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("page_id").alias("obs"), "title")
    url = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("obs"), "url")
    return observe.build(made, titles.join(url, "obs").select(F.col("obs").cast("string").alias("session"), "obs", "title", "url"))


@query
def utility(spark, sf_dir):
    w = cut(walked(spark, sf_dir), "walked")
    el, tx = elements_of(w), texts_of(w)
    made = sanitized(spark, sf_dir, w)
    return observe.utility(el, tx, made.elements, made.texts)


@query
def observe_page(spark, sf_dir):
    """What the walk knows of each page: counts, kind and bounds."""
    w = walked(spark, sf_dir)
    count = lambda f: F.size(F.filter("elements", f)).cast("long")
    rows = w.join(pages.titles(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "title"), "page_id").join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "page_id")
    kind = layout.page_type(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract("url", "([?][^#]*)", 1), F.col("title"), count(lambda e: e["type"] == "password"), count(lambda e: e["tag"].isin("input", "textarea", "select")), count(lambda e: e["tag"] == "a"), F.lit(0))
    return rows.select("page_id", "title", kind.alias("type"), F.size("elements").cast("long").alias("elements"), F.size("texts").cast("long").alias("texts"), "truncated")


@query
def dom_path(spark, sf_dir):
    """Paths, names, roles and states of elements."""
    fields = ("path", "name", "role", "hidden", "focusable", "disabled", "checked")
    return pages.walk(spark.read.parquet(f"{sf_dir}/pages.parquet"), hidden=True).select("page_id", F.explode("elements").alias("e")).select("page_id", "e.id", "e.tag", "e.kind", *[f"e.{f}" for f in fields])


@scene_query(f"WITH {EL} SELECT obs, 'e' || id AS part, '[REDACTED]' AS shown, (floor(x / 4 + 0.5) * 4) AS qx, (floor(h / 4 + 0.5) * 4) AS qh FROM el UNION ALL SELECT obs, 't' || id, '[REDACTED]', floor(x / 4 + 0.5) * 4, floor(h / 4 + 0.5) * 4 FROM tx")
def sanitize_fallback(spark, sf_dir):
    el, tx = observe.fallback(scene_elements(spark, sf_dir).withColumn("placeholder_raw", F.lit("")), scene_texts(spark, sf_dir).withColumn("text", F.lit("secret")))
    one = lambda df, kind, shown: df.select("obs", F.concat(F.lit(kind), "id").alias("part"), F.col(shown).alias("shown"), F.col("rect.x").alias("qx"), F.col("rect.h").alias("qh"))
    return one(el, "e", "label_raw").unionByName(one(tx, "t", "text"))


@scene_query("WITH s AS (SELECT event_id AS obs, CASE event_id % 3 WHEN 0 THEN 'ner' WHEN 1 THEN 'ocr' ELSE 'vision' END AS source, event_type <> 'error' AS ok, value > 50 AS late FROM events), f AS (SELECT obs, source, source || CASE WHEN late THEN '_timeout' ELSE '_error' END AS why FROM s WHERE late OR NOT ok) SELECT obs, why AS reason, source || ': ' || why AS told FROM f WHERE source <> 'vision'")
def source_timeout(spark, sf_dir):
    """Sources that failed or took more than 50 ms, and what they leave unexplained; vision covers nothing."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 3 == 0, "ner").when(F.col("event_id") % 3 == 1, "ocr").otherwise("vision")
    status = ev.select(F.col("event_id").alias("obs"), name.alias("source"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed_ms"), F.lit(50).alias("timeout_ms"))
    coverage = status.where("source <> 'vision'").select("obs", F.lit(0).alias("ord"), "source", G.rect(F.lit(0), F.lit(0), F.lit(8), F.lit(8)).alias("rect"))
    degraded, lost = observe.sources(status, coverage)
    return lost.select("obs", F.col("reason").alias("told")).join(degraded, "obs").select("obs", "reason", "told")


@scene_query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[example email]' WHEN turn % 3 = 1 THEN 'your name' ELSE '' END AS placeholder FROM conversations")
def scrub_placeholder(spark, sf_dir):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@zmail.in"))).when(F.col("turn") % 3 == 1, "your name").otherwise("")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", observe.scrub_placeholder(said).alias("placeholder"))


