"""What a page shows and gives away when sources of evidence fail: every set of the fallible sources in every way to fail, in one pass.

Evidence is found once. A setting only masks evidence and, where the failure is seen, turns what the failed source would have covered into unexplained rectangles. Settings that
mask alike share a state (throwing and timing out are both seen). States are bits of a number: rectangles and evidence meet once for all states and profiles, what travels tells the
states in which it holds, and rows for states and settings are made last. Pages meet no other pages: all joins are by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.functions.text import let

from . import fusion
from . import geometry as G

SOURCES, MODES = ("ner", "ocr", "vision"), ("throw", "timeout", "silent")
_SILENT = 1 << len(SOURCES)
#: Sets of failed sources as bits; those that fail unseen have one bit more. 0: healthy.
STATES = tuple(range(_SILENT)) + tuple(_SILENT + k for k in range(1, _SILENT))


def settings(spark: SparkSession) -> DataFrame:
    """(setting int, label, mode, failed array<string>, state int): healthy, then each set in each mode."""
    names = F.array(*map(F.lit, SOURCES))
    chosen = F.filter(names, lambda x, i: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    rows = spark.range(1, 1 + (_SILENT - 1) * len(MODES)).select(F.col("id").cast("int").alias("setting"), F.pmod(F.col("id") - 1, F.lit(_SILENT - 1)).cast("int") + F.lit(1), F.get(F.array(*map(F.lit, MODES)), F.floor((F.col("id") - 1) / (_SILENT - 1)).cast("int")))
    rows = rows.toDF("setting", "mask", "mode").withColumn("failed", chosen)
    rows = rows.select("setting", F.concat_ws(" ", F.array_join("failed", "+"), "mode").alias("label"), "mode", "failed", (F.col("mask") + F.when(F.col("mode") == "silent", _SILENT).otherwise(0)).alias("state"))
    return spark.range(1).select(F.lit(0).alias("setting"), F.lit("healthy").alias("label"), F.lit("none").alias("mode"), F.array().cast("array<string>").alias("failed"), F.lit(0).alias("state")).unionByName(rows)


def _mask(source: Column, holds) -> Column:
    """The states, as bits by their place in STATES, in which holds(state, bit of the source), a source that doesn't fail having none."""
    of = lambda bit: F.lit(sum(1 << i for i, state in enumerate(STATES) if holds(state, bit)))
    return F.coalesce(*[F.when(source == s, of(1 << k)) for k, s in enumerate(SOURCES)], of(0))


def _has(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(bit) != 0


def regions(evidence: DataFrame, coverage: DataFrame, profiles: tuple[str, ...], cell: int = G.CELL) -> DataFrame:
    """(obs, rect, hidden array<int>): the regions of fusion.fuse(), and for each profile the states in which it is redacted. evidence(obs, ord long, source, type, pii_type, confidence,
    rect), coverage(obs, ord, source, rect, reason): what each fallible source answers for."""
    placed = evidence.where("rect IS NOT NULL").select("obs", "rect", F.struct("ord", _mask(F.col("source"), lambda s, bit: not s & bit).alias("mask"), "type", "pii_type", "confidence").alias("e"))
    odd = coverage.select("obs", fusion.snap(F.col("rect")).alias("rect"), _mask(F.col("source"), lambda s, bit: s < _SILENT and s & bit).alias("odd"))
    made = placed.select("obs", fusion.snap(F.col("rect")).alias("rect"), F.col("e.mask").alias("made"), F.lit(0).alias("odd")).unionByName(odd.withColumn("made", F.col("odd")))
    made = made.groupBy("obs", "rect").agg(F.bit_or("made").alias("made"), F.bit_or("odd").alias("odd"))
    met = G.overlap_join(made.select("obs", "rect"), placed, "obs", "rect", "e", cell=cell).select("obs", "rect", "e", F.lit(0).alias("made"), F.lit(0).alias("odd"))
    all_ = met.unionByName(made.withColumn("e", F.lit(None).cast(placed.schema["e"].dataType))).groupBy("obs", "rect")
    per = all_.agg(F.array_sort(F.collect_list("e")).alias("t"), F.bit_or("made").alias("made"), F.bit_or("odd").alias("odd"))
    return per.select("obs", "rect", F.array(*map(_hidden, profiles)).alias("hidden")).where(F.exists("hidden", lambda h: h != 0))


def _hidden(profile: str) -> Column:
    """The states in which a region(t, made, odd) is redacted, scored over the evidence that is there."""
    p = schema.PROFILES[profile]
    weight = lambda c: F.coalesce(*[F.when(c == k, F.lit(p[k])) for k in ("regex", "ner", "ocr", "vision", "deterministic")])
    rate = lambda e: F.struct(e["mask"].alias("mask"), (weight(e["type"]) * e["confidence"]).alias("term"), ((fusion.tier_for_type(e["pii_type"]) == 1) & (weight(e["type"]) > 0)).alias("holds"))
    own = lambda bit: F.when(_has(F.col("odd"), bit), 1 - fusion.clamp01(F.lit(p["deterministic"] * p["unexplained_prior"]))).otherwise(1.0)

    def redacted(bit: Column, rated: Column) -> Column:
        def decided(e: Column) -> Column:
            score = 1 - F.aggregate(e, F.lit(1.0), lambda c, x: c * (1 - fusion.clamp01(x["term"]))) * own(bit)
            said = let(F.struct(score.alias("s"), F.exists(e, lambda x: x["holds"]).alias("h")), lambda z: fusion.decide(profile, z["s"], F.when(z["h"], 1)) != "PASS")
            return ((F.size(e) > 0) | _has(F.col("odd"), bit)) & said

        return _has(F.col("made"), bit) & let(F.filter(rated, lambda x: _has(x["mask"], bit)), decided)

    bits = F.array(*[F.lit(1 << i) for i in range(len(STATES))])
    return let(F.transform("t", rate), lambda rated: F.aggregate(F.filter(bits, lambda b: redacted(b, rated)), F.lit(0), lambda s, b: s.bitwiseOR(b)))


_PAGE, _REGION, _VALUE, _READABLE, _FIRST = 0, 1, 2, 4, 8


def run_all(pages: DataFrame, evidence: DataFrame, coverage: DataFrame, truth: DataFrame, profiles: tuple[str, ...], cell: int = G.CELL) -> DataFrame:
    """run() for several profiles, with a column profile. cell: size of the cells in which rectangles meet."""
    redacted = regions(evidence, coverage, profiles, cell)
    leaves = F.coalesce("readable", F.lit(False))
    kind = F.lit(_VALUE) + F.when(leaves, _READABLE).otherwise(0) + F.when(leaves & (F.col("tier") == 1), _FIRST).otherwise(0)
    values = truth.select("obs", F.struct("vid", kind.alias("kind")).alias("v"), "rect")
    none = F.array(*[F.lit(0) for _ in profiles])
    met = G.overlap_join(values, redacted, "obs", "v", "hidden", cell=cell).select("obs", "v", "hidden").unionByName(values.select("obs", "v", none.alias("hidden")))
    each = [F.bit_or(F.col("hidden")[k]).alias(f"h{k}") for k in range(len(profiles))]
    covered = met.groupBy("obs", "v").agg(*each).select("obs", F.col("v.kind").alias("kind"), F.array(*[f"h{k}" for k in range(len(profiles))]).alias("hidden"))
    # a page's regions and values are hidden in few different sets of states
    rows = covered.unionByName(redacted.select("obs", F.lit(_REGION).alias("kind"), "hidden")).unionByName(pages.select("obs", F.lit(_PAGE).alias("kind"), none.alias("hidden")))
    rows = rows.where("obs IS NOT NULL").groupBy("obs", "kind", "hidden").agg(F.count("*").alias("n"))
    rows = rows.groupBy("obs").agg(F.collect_list(F.struct("kind", "hidden", "n")).alias("all")).where(F.exists("all", lambda e: e["kind"] == _PAGE))

    def told(k: int, at: Column) -> Column:
        total = lambda kind, hidden: F.aggregate("all", F.lit(0).cast("long"), lambda s, e: s + F.when(_has(e["kind"], F.lit(kind)) & (_has(e["hidden"][k], at["bit"]) == hidden), e["n"]).otherwise(0))
        return F.struct(F.lit(profiles[k]).alias("profile"), at["state"].alias("state"), total(_REGION, True).alias("redactions"), total(_VALUE, False).alias("missed"), total(_READABLE, False).alias("leaked"), total(_FIRST, False).alias("tier1_exposed"))

    states = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(state).alias("state")) for i, state in enumerate(STATES)])
    of = lambda k: let(F.transform(states, lambda at: told(k, at)), lambda a: F.transform(a, lambda r: F.struct(r.alias("r"), a[0]["redactions"].alias("r0"), a[0]["leaked"].alias("l0"))))
    rows = rows.select("obs", F.explode(F.concat(*map(of, range(len(profiles))))).alias("x")).select("obs", "x.r.*", "x.r0", "x.l0")
    rows = rows.join(F.broadcast(settings(pages.sparkSession)), "state")
    degraded = F.when(F.col("mode").isin("throw", "timeout"), F.array_join("failed", "+")).otherwise("")
    return rows.select("obs", "setting", "label", "mode", degraded.alias("degraded"), "redactions", "missed", "leaked", "tier1_exposed", (F.col("leaked") > F.col("l0")).alias("leaks_more"), (F.col("redactions") < F.col("r0")).alias("redacts_less"), "profile")


def run(pages: DataFrame, evidence: DataFrame, coverage: DataFrame, truth: DataFrame, profile: str) -> DataFrame:
    """(obs, setting, label, mode, degraded, redactions, missed, leaked, tier1_exposed, leaks_more, redacts_less) for each of pages(obs) and each setting.

    truth(obs, vid, tier, rect, readable): values that a page shows; a readable one leaves with the page's text unless a redacted rectangle meets it. degraded: the failed
    sources that the system can name. The last two compare with the healthy setting.
    """
    return run_all(pages, evidence, coverage, truth, (profile,)).drop("profile")


def summary(results: DataFrame) -> DataFrame:
    """(setting, label, pages, redactions, missed, leaked, tier1_exposed, leaking_more, redacting_less) over all pages."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    return results.groupBy("setting", "label").agg(F.count("*").alias("pages"), *map(total, ("redactions", "missed", "leaked", "tier1_exposed")), F.count_if("leaks_more").alias("leaking_more"), F.count_if("redacts_less").alias("redacting_less"))
