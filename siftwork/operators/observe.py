"""A page's observation made safe: everything that is recognized in it, what no one can explain, and what remains to be sent.

Tables of a page, whose nodes the extractor bounds: elements(session, obs, ord, id, tag, type, input_type, role, autocomplete, maxlength,
label_raw, placeholder_raw, rect, visible, enabled, unexplained), texts(session, obs, ord, id, text, rect), frames(obs, ord, id, rect, origin),
evidence(session, obs, ord, source, type, pii_type, confidence, rect, value) of perception sources, and failures(obs, ord, source, reason, rect): what a
source that failed or ran out of time would have covered. Observations of a session follow one another by obs. Nulls in texts and labels count as empty.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema
from siftwork.operators import context, fusion, geometry as G, layout, recognize, session
from siftwork.tables import cut

RECOGNIZED = tuple(recognize.RECOGNIZERS)
HANDLE_INSIDE = "⟦[^⟧]+⟧"


def rec_observation(elements: DataFrame, texts: DataFrame, names=RECOGNIZED) -> DataFrame:
    """(session, obs, at struct<phase, node, part, nth>, kind, id, type, tier, confidence, value, rect): values in labels and texts, values named by what
    stands beside them, elements whose rules say what they will hold, in the order in which handles are numbered by `at`; last, as kind example, values in placeholders."""
    at = lambda phase, part: F.struct(F.lit(phase).alias("phase") if isinstance(phase, int) else phase, F.col("ord").cast("long").alias("node"), F.lit(part).alias("part"), F.col("nth").cast("long").alias("nth")).alias("at")
    hit = ("s.type", "s.tier", "s.confidence")
    keep = ("session", "obs", "ord", "id", "rect")

    # all texts in one table: the recognizers are one long expression
    said = lambda rows, text, phase: rows.select(*keep, F.lit(phase).alias("phase"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = said(elements, "label_raw", 0).unionByName(said(texts, "text", 1)).unionByName(said(elements, "placeholder_raw", 9)).where("text <> ''")
    found = every.select(*keep, "phase", F.posexplode(recognize.recognize(F.col("text"), names)).alias("nth", "s"))
    values = found.select("session", "obs", at(F.col("phase"), 0), F.when(F.col("phase") == 9, "example").otherwise("value").alias("kind"), "id", *hit, "s.value", "rect")
    rules = elements.select(*keep, F.posexplode(context.field_rules()).alias("nth", "s"))
    rules = rules.select("session", "obs", at(0, 1), F.lit("element").alias("kind"), "id", *hit, F.lit("").alias("value"), "rect")
    nodes = texts.select("obs", "ord", "id", F.coalesce("text", F.lit("")).alias("text"), "rect.x", "rect.y", "rect.w", "rect.h")
    beside = context.hits(nodes).join(texts.select("session", "obs", "id", "ord", "rect"), ["obs", "id"])
    beside = beside.withColumn("nth", F.when(F.col("confidence") < 0.85, 1).otherwise(0)).select("session", "obs", at(2, 0), F.lit("value").alias("kind"), "id", "type", "tier", "confidence", "value", "rect")
    return values.unionByName(rules).unionByName(beside)


def noted(first_type: Column) -> Column:
    """What stands for a placeholder that looks like a value of a type."""
    return F.concat(F.lit("[example "), F.lower(first_type), F.lit("]"))


def scrub_placeholder(text: Column) -> Column:
    """Placeholders are examples: one that looks like a value is replaced by a note."""
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(context.let(recognize.recognize(text), lambda s: F.when(F.size(s) > 0, noted(s[0]["type"])).otherwise(text)))


def sources(status: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(degraded(obs, reason), failures(obs, ord, source, reason, rect)) of status(obs, source, ok, elapsed_ms, timeout_ms) and coverage(obs, ord, source,
    rect): a source that failed or took too long leaves what it covers unexplained."""
    late = F.col("elapsed_ms") > F.col("timeout_ms")
    failed = status.where(late | ~F.col("ok")).select("obs", "source", F.concat("source", F.when(late, "_timeout").otherwise("_error")).alias("why"))
    lost = coverage.join(failed, ["obs", "source"]).select("obs", "ord", "source", F.concat("source", F.lit(": "), "why").alias("reason"), "rect")
    return failed.select("obs", F.col("why").alias("reason")), lost


def element_class(hits: DataFrame) -> DataFrame:
    """(obs, id, class): of the types that its rules give an element the one of the lowest tier, the later of equals."""
    ruled = hits.where("kind = 'element'").withColumn("type", session.norm_type(F.col("type")))
    best = F.max_by("type", F.struct((-fusion.tier_for_type(F.col("type"))).alias("tier"), F.col("at.nth").alias("nth")))
    return ruled.groupBy("obs", "id").agg(best.alias("class"))


class Sanitized:
    """Elements with label, placeholder, class and actions, texts, handles(session, key, kind, tier, handle) and redactions(obs, rect, reason, source, score).

    Values of a session are replaced by its handles wherever they stand. Regions that no evidence and no element explains are redacted, and a text below one is withheld
    as a whole; such texts are numbered behind the recognized values of their session. Each table is worked out where it is asked for, and what several of them read is written once.
    """

    def __init__(self, elements: DataFrame, texts: DataFrame, frames: DataFrame, evidence: DataFrame, failures: DataFrame, profile: str):
        self._elements, self._texts, self._frames, self._evidence, self._failures, self._profile = elements, texts, frames, evidence, failures, profile

    @cached_property
    def _hits(self) -> DataFrame:
        return cut(rec_observation(self._elements, self._texts), "observed-hits")

    @cached_property
    def _seen(self) -> DataFrame:
        """(session, obs, ord, at, type, pii_type, confidence, rect, value, tier): what is recognized and what sources say, numbered in each observation."""
        shown = F.trim("value")
        named = self._evidence.where(F.col("value").isNull() | ((F.length(shown) >= 3) & context.label_type(shown).isNull()))
        named = named.select("session", "obs", F.struct(F.lit(3).alias("phase"), F.col("ord").cast("long").alias("node"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth")).alias("at"), "type", session.norm_type(F.col("pii_type")).alias("pii_type"), "confidence", "rect", "value")
        named = named.withColumn("tier", fusion.tier_for_type(F.col("pii_type")))
        own = self._hits.where("kind <> 'example'").select("session", "obs", "at", F.lit("regex").alias("type"), session.norm_type(F.col("type")).alias("pii_type"), "confidence", "rect", F.when(F.col("kind") == "value", F.col("value")).alias("value"), "tier")
        return cut(own.unionByName(named).withColumn("ord", F.row_number().over(W.partitionBy("obs").orderBy("at", "pii_type")).cast("long")), "observed-evidence")

    @cached_property
    def _handles(self) -> DataFrame:
        values = self._seen.where("value IS NOT NULL").select("session", F.struct("obs", "at").alias("ord"), "value", F.col("pii_type").alias("type"), "tier")
        return cut(session.numbered(values), "observed-handles")

    @cached_property
    def _regions(self) -> DataFrame:
        elements, profile = self._elements, self._profile
        detections = self._seen.select("obs", "ord", "type", "pii_type", "confidence", "rect")
        touched = G.overlap_join(elements.select("obs", "id", "rect"), detections.where("rect IS NOT NULL"), "obs", "id", "ord", pages=True).select("obs", "id").distinct()
        candidates, explained = layout.partition_explained(elements, self._texts, self._frames, touched)
        odd = fusion.explain_or_redact(candidates, explained, schema.PROFILES[profile]["min_coverage"]).select("obs", F.concat(F.lit("0"), "id").alias("nth"), "rect", "reason")
        odd = odd.unionByName(self._failures.select("obs", F.concat(F.lit("1"), F.lpad(F.col("ord").cast("string"), 9, "0")).alias("nth"), "rect", "reason"))
        odd = odd.select("obs", F.row_number().over(W.partitionBy("obs").orderBy("nth")).cast("long").alias("ord"), "rect", "reason")
        return cut(fusion.fuse(detections, odd, profile).where("action <> 'PASS'").withColumn("region", F.to_json("rect")), "observed-regions")

    @cached_property
    def _marked(self) -> DataFrame:
        """Texts with handles in place of values, and whether each is withheld."""
        texts = self._texts
        bare = self._regions.where("n_evidence = 0")
        over = texts.join(G.overlap_join(texts.select("obs", "id", "rect"), bare, "obs", "id", "region", pages=True).select("obs", "id").distinct().withColumn("bare", F.lit(True)), ["obs", "id"], "left")
        known = session.substitute_known(over.withColumn("text", F.coalesce("text", F.lit(""))), "text", self._handles, ["obs", "id"])
        withheld = F.coalesce(F.col("bare"), F.lit(False)) & (F.trim("text") != "") & ~F.col("text").rlike(HANDLE_INSIDE)
        return cut(known.withColumn("withheld", withheld), "observed-texts")

    @cached_property
    def _more(self) -> DataFrame:
        """Handles of withheld texts."""
        more = session.numbered(self._marked.where("withheld").select("session", F.struct("obs", "ord").alias("ord"), F.col("text").alias("value"), F.lit("PERSONAL").alias("type"), F.lit(3).alias("tier")))
        ahead = self._handles.groupBy("session").agg(F.max("index").alias("ahead"))
        more = more.join(ahead, "session", "left").withColumn("index", F.col("index") + F.coalesce("ahead", F.lit(0))).drop("ahead")
        return more.withColumn("handle", session.handle(F.col("kind"), F.col("tier"), F.col("index")))

    @cached_property
    def texts(self) -> DataFrame:
        replaced = self._marked.withColumn("key", session.key_of(F.col("text"))).join(self._more.select("session", "key", "handle"), ["session", "key"], "left")
        return replaced.select("session", "obs", "ord", "id", F.when(F.col("withheld"), F.col("handle")).otherwise(F.col("text")).alias("text"), G.quantize_rect(F.col("rect")).alias("rect"))

    @cached_property
    def elements(self) -> DataFrame:
        elements, hits, regions = self._elements, self._hits, self._regions
        interactive = F.col("tag").isin(*schema.INTERACTIVE_TAGS)
        strongest = lambda e: F.array_max(F.transform(F.filter(e, lambda d: d["pii_type"] != "NONE"), lambda d: F.struct(d["confidence"].alias("c"), (-d["ord"]).alias("o"), d["pii_type"].alias("pii_type"))))
        told = regions.select("obs", "rect", F.struct(strongest(F.col("evidence")).alias("strongest"), (F.col("n_evidence") == 0).alias("unread")).alias("told"))
        met = G.overlap_join(elements.where(~interactive).select("obs", "id", "rect"), told, "obs", "id", "told", pages=True).where(G.overlap_fraction(F.col("l"), F.col("r")) >= 0.5)
        inside = met.groupBy("obs", "id").agg(F.max("told.strongest")["pii_type"].alias("from_region"), F.bool_or("told.unread").alias("unread"), F.lit(True).alias("inside"))
        examples = hits.where("kind = 'example'").groupBy("obs", "id").agg(noted(F.min_by("type", "at")).alias("example"))
        rows = elements.join(element_class(hits), ["obs", "id"], "left").join(inside, ["obs", "id"], "left").join(examples, ["obs", "id"], "left")
        label = F.coalesce("label_raw", F.lit(""))
        cls = F.coalesce("class", "from_region", F.when(F.col("inside") & (label == ""), "PERSONAL"), layout.class_fallback())
        rows = rows.withColumn("sensitivity_class", F.nullif(cls, F.lit("NONE"))).withColumn("label", label)
        rows = session.substitute_known(rows, "label", self._handles, ["obs", "id"])
        masked = ~interactive & F.coalesce(F.col("unread"), F.lit(False)) & F.col("unexplained") & (F.col("label") != "")
        return rows.select(
            "session", "obs", "ord", "id", "tag", "role", "type", F.when(masked, "[REDACTED]").otherwise(F.col("label")).alias("label_raw"), F.coalesce("example", "placeholder_raw").alias("placeholder_raw"),
            G.quantize_rect(F.col("rect")).alias("rect"), "visible", "enabled", "unexplained", "autocomplete", "input_type", context.actions().alias("available_actions"), "sensitivity_class",
        )

    @cached_property
    def handles(self) -> DataFrame:
        fields = ["session", "key", "kind", "tier", "handle"]
        return self._handles.select(*fields).unionByName(self._more.select(*fields))

    @cached_property
    def redactions(self) -> DataFrame:
        return self._regions.select("obs", "rect", "reason", "source", F.least(F.lit(1.0), F.col("sensitivity")).alias("score"))


def sanitize(elements: DataFrame, texts: DataFrame, frames: DataFrame, evidence: DataFrame, failures: DataFrame, profile: str = "STRICT") -> Sanitized:
    """What remains to be sent of observations, and what was taken out of them."""
    return Sanitized(elements, texts, frames, evidence, failures, profile)


def fallback(elements: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and texts of which nothing is shown: what is sent where sanitizing failed."""
    hidden = F.lit("[REDACTED]")
    shown = F.when(F.coalesce(F.col("placeholder_raw"), F.lit("")) != "", hidden)
    rows = elements.withColumns({"label_raw": hidden, "placeholder_raw": shown, "sensitivity_class": F.lit("PERSONAL"), "available_actions": F.array().cast("array<string>"), "rect": G.quantize_rect(F.col("rect"))})
    return rows, texts.withColumns({"text": hidden, "rect": G.quantize_rect(F.col("rect"))})


def build(made: Sanitized, pages: DataFrame, max_elements: int = 400, max_texts: int = 300) -> DataFrame:
    """(session, obs, title, url, elements, texts, handles, truncated): one row for each of pages(session, obs, title, url), with title and address
    substituted as well. The extractor's bounds on a page hold here, too."""
    nodes = lambda df, limit, *fields: df.groupBy("obs").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("all")).select("obs", F.slice("all", 1, limit).alias("nodes"), (F.size("all") > limit).alias("cut"))
    el = nodes(made.elements, max_elements, "id", "tag", "role", "type", "label_raw", "placeholder_raw", "rect", "visible", "enabled", "available_actions", "sensitivity_class").withColumnsRenamed({"nodes": "elements", "cut": "truncated"})
    tx = nodes(made.texts, max_texts, "id", "text", "rect").withColumnsRenamed({"nodes": "texts", "cut": "__cut"}).drop("__cut")
    page = pages
    for c in ("title", "url"):
        page = session.substitute_known(page.withColumn(c, F.coalesce(c, F.lit(""))), c, made.handles, ["obs"])
    used = F.array_distinct(F.flatten(F.transform(F.concat(F.coalesce("elements.label_raw", F.array()), F.coalesce("texts.text", F.array()), F.array("title", "url")), lambda t: F.regexp_extract_all(t, F.lit(r"⟦[A-Z_]+(?:#[0-9]+)?⟧"), F.lit(0)))))
    return page.join(el, "obs", "left").join(tx, "obs", "left").withColumn("handles", F.array_sort(used)).select("session", "obs", "title", "url", "elements", "texts", "handles", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def utility(raw_elements: DataFrame, raw_texts: DataFrame, elements: DataFrame, texts: DataFrame) -> DataFrame:
    """(obs, n, usable, actionable, literal): elements whose label came through and that offer an action, and the share of texts' characters that are still text."""
    same = raw_elements.select("obs", "id", F.col("label_raw").alias("__raw")).join(elements.select("obs", "id", "label_raw", "available_actions"), ["obs", "id"], "left")
    usable = F.coalesce((F.col("label_raw") == F.col("__raw")) & (F.size("available_actions") > 0), F.lit(False))
    per = same.groupBy("obs").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable"))
    chars = raw_texts.groupBy("obs").agg(F.sum(F.length("text")).alias("chars"))
    left = texts.groupBy("obs").agg(F.sum(F.length(F.regexp_replace("text", r"⟦[A-Z_]+(?:#[0-9]+)?⟧|\[REDACTED\]", ""))).alias("left"))
    share = F.when(F.coalesce("chars", F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("left", F.lit(0)) / F.col("chars")))
    return per.join(chars, "obs", "left").join(left, "obs", "left").select("obs", "n", "usable", (F.col("usable") / F.col("n")).alias("actionable"), share.alias("literal"))
