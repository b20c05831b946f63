"""Noisy-OR fusion of evidence over regions, coverage, and policy decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema

from . import geometry as G

GRID, OWNERS = 8, 24

def tier_for_type(kind: Column) -> Column:
    return F.when(kind.isin(*schema.TIER1), 1).when(kind.isin(*schema.TIER2), 2).otherwise(3)


def clamp01(v: Column) -> Column:
    return F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def noisy_or(terms: Column) -> Column:
    """1 minus the product of 1 - t, in the array's order; nothing: 0."""
    return F.lit(1.0) - F.aggregate(terms, F.lit(1.0), lambda c, t: c * (1 - clamp01(t)))


def decide(profile: str, sensitivity: Column, tier: Column) -> Column:
    """Action for a score; a null tier passes below the first threshold."""
    p = schema.PROFILES[profile]
    by_tier = F.lit("PASS")
    for k in range(5, 0, -1):
        action = p[f"T{k}"]
        by_tier = F.when(tier == k, "PASS" if action == "ANNOTATE" else action).otherwise(by_tier)
    return F.when(tier == 1, "VAULT_ONLY").when(sensitivity >= p["drop"], "DROP").when(sensitivity >= p["mask"], "MASK").when(sensitivity >= p["tokenize"], "TOKENIZE").when(tier.isNull(), "PASS").otherwise(by_tier)


def snap(r: Column) -> Column:
    """x and y down, w and h up to the grid, each by itself: the far edges may stick out."""
    return G.rect(F.floor(r["x"] / GRID) * GRID, F.floor(r["y"] / GRID) * GRID, F.ceil(r["w"] / GRID) * GRID, F.ceil(r["h"] / GRID) * GRID)


def fuse(detections: DataFrame, unexplained: DataFrame, profile: str) -> DataFrame:
    """(obs, rect, sensitivity, n_evidence, action, source, reason, evidence) from detections(obs, ord, type, pii_type, confidence, rect) and
    unexplained(obs, ord, rect, reason): regions are the snapped rectangles of both, scored over all evidence that meets them."""
    p = schema.PROFILES[profile]
    placed = detections.where("rect IS NOT NULL")
    seen = placed.select("obs", snap(F.col("rect")).alias("rect"), F.lit(None).cast("long").alias("u_ord"), F.lit(None).cast("string").alias("reason"))
    odd = unexplained.select("obs", snap(F.col("rect")).alias("rect"), F.col("ord").cast("long").alias("u_ord"), "reason")
    anchors = seen.unionByName(odd).groupBy("obs", "rect").agg(F.min(F.when(F.col("u_ord").isNotNull(), F.struct("u_ord", "reason"))).alias("u"))
    anchors = anchors.withColumn("anchor", F.to_json("rect"))
    weight = lambda c: F.coalesce(*[F.when(c == k, F.lit(p[k])) for k in ("regex", "ner", "ocr", "vision", "deterministic")])
    said = F.struct("ord", "type", "pii_type", "confidence", (weight(F.col("type")) * F.col("confidence")).alias("term"), (weight(F.col("type")) > 0).alias("counts"))
    terms = G.overlap_join(anchors, placed.select("obs", "rect", said.alias("said")), "obs", "anchor", "said", pages=True).select("obs", "anchor", "said.*")
    per = terms.groupBy("obs", "anchor").agg(
        F.array_sort(F.collect_list(F.struct("ord", "term", "type", "pii_type", "confidence"))).alias("t"), F.count("*").alias("n_evidence"), F.bool_or((tier_for_type(F.col("pii_type")) == 1) & F.col("counts")).alias("holds"),
        F.array_join(F.array_sort(F.collect_set("pii_type")), "+").alias("kinds"), F.array_join(F.array_sort(F.collect_set("type")), "+").alias("sources"),
    )
    out = anchors.join(per, ["obs", "anchor"], "left").where("t IS NOT NULL OR u IS NOT NULL")
    own = F.when(F.col("u").isNotNull(), F.array(F.struct(F.lit(None).cast("bigint").alias("ord"), F.lit(p["deterministic"] * p["unexplained_prior"]).alias("term"), F.lit("deterministic").alias("type")))).otherwise(F.array())
    evidence = F.coalesce(F.transform("t", lambda x: F.struct(x["ord"].cast("bigint").alias("ord"), x["term"].alias("term"), x["type"].alias("type"))), F.array())
    out = out.withColumn("all", F.concat(evidence, own)).withColumn("sensitivity", noisy_or(F.transform("all", lambda x: x["term"])))
    strongest = F.aggregate("all", F.struct(F.lit(-1.0).alias("term"), F.lit("").alias("type")), lambda a, x: F.when(x["term"] > a["term"], F.struct(x["term"].alias("term"), x["type"].alias("type"))).otherwise(a))
    tier = F.when(F.col("holds"), 1)
    cause = F.concat_ws("; ", F.col("u.reason"), F.when(F.col("n_evidence") > 0, F.concat_ws(" from ", "kinds", "sources")))
    action = decide(profile, F.col("sensitivity"), tier)
    words = F.when(tier == 1, F.concat(F.lit(": tier-1 secret, "), cause)).otherwise(F.concat(F.lit(": "), cause))
    return out.select("obs", "rect", "sensitivity", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), action.alias("action"), strongest["type"].alias("source"), F.concat(action, words, F.format_string(" (S=%.2f)", "sensitivity")).alias("reason"), F.transform("t", lambda x: F.struct(x["ord"].alias("ord"), x["pii_type"].alias("pii_type"), x["confidence"].alias("confidence"))).alias("evidence"))


def coverage(candidates: DataFrame, explained: DataFrame) -> DataFrame:
    """(obs, id, rect, coverage): the share of each candidate(obs, id, rect) that the OWNERS largest parts of explained(obs, eid, rect) cover; no area: 1."""
    met = G.overlap_join(candidates, explained, "obs", "id", "eid", pages=True).select("obs", "id", "eid", G.intersect(F.col("l"), F.col("r")).alias("part"))
    nth = F.row_number().over(W.partitionBy("obs", "id").orderBy(F.desc(G.area(F.col("part"))), "eid"))
    parts = met.withColumn("nth", nth).where(F.col("nth") <= OWNERS).groupBy("obs", "id").agg(F.collect_list("part").alias("parts"))
    whole = G.area(F.col("rect"))
    share = F.when(whole <= 0, 1.0).when(F.col("parts").isNull(), 0.0).otherwise(F.least(F.lit(1.0), G.area_union(F.col("parts")) / whole))
    return candidates.join(parts, ["obs", "id"], "left").select("obs", "id", "rect", share.alias("coverage"))


def explain_or_redact(candidates: DataFrame, explained: DataFrame, least: float) -> DataFrame:
    """Candidates(obs, id, rect, reason) covered less than least, with the reason told."""
    share = coverage(candidates.select("obs", "id", "rect"), explained).where(F.col("coverage") < least).select("obs", "id", "coverage")
    told = F.when(F.col("coverage") == 0, F.concat("reason", F.lit(", no DOM owner"))).otherwise(F.concat("reason", F.format_string(", only %.0f%% owned by the DOM", F.col("coverage") * 100)))
    return candidates.join(share, ["obs", "id"]).select("obs", "id", "rect", "coverage", told.alias("reason"))


def top_crops(regions: DataFrame, budget: int = 6) -> DataFrame:
    """regions(obs, id, rect, suspicion) with taken: the budget's largest, more suspicious ones first among equals; the others stay, deferred."""
    order = W.partitionBy("obs").orderBy(F.desc(G.area(F.col("rect"))), F.desc("suspicion"), "id")
    return regions.withColumn("taken", F.row_number().over(order) <= budget)
