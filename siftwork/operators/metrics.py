"""Scores of detectors and of releases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.operators import geometry


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull; 0 without overlap."""
    both = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when(both <= 0, 0.0).otherwise(both / (F.greatest(a1, b1) - F.least(a0, b0)))


def cer(predicted: Column, reference: Column) -> Column:
    return F.when(F.length(reference) == 0, F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(predicted, reference) / F.length(reference))


def char_accuracy(error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - error_rate)


def slope(value: Column, at: Column) -> Column:
    """Aggregate: from the first value to the last by `at`, for each step between; null for one row."""
    return F.when(F.count("*") > 1, (F.max_by(value, at) - F.min_by(value, at)) / (F.count("*") - 1))


def matched(predicted: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, type, tp, fp, fn) of predicted and gold(doc_id, ord, start, end, type): each predicted span, in order, takes the first gold span left that has its type and overlaps enough."""
    names = ["doc_id", "type", "ord", "start", "end"]
    sides = [df.select(*names, F.lit(side).alias("side")) for side, df in enumerate((predicted, gold))]
    met = sides[0].unionByName(sides[1]).groupBy("doc_id", "type").agg(F.array_sort(F.collect_list(F.struct("side", "ord", "start", "end"))).alias("spans"))

    def counted(spans: list[tuple]) -> tuple[int, int, int]:
        left = [x[2:] for x in spans if x[0] == 1]
        tp = 0
        for side, _, s, e in spans:
            if side == 1:
                break
            for i, (a, b) in enumerate(left):
                if None not in (s, e, a, b) and (both := min(e, b) - max(s, a)) > 0 and both / (max(e, b) - min(s, a)) >= least:
                    tp += 1
                    del left[i]
                    break
        return tp, sum(x[0] == 0 for x in spans) - tp, len(left)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for spans in part.column(2):
                    flat = spans.values
                    found.append(counted(list(zip(*[flat.field(n).to_pylist() for n in ("side", "ord", "start", "end")], strict=True))))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)]], names=["doc_id", "type", "tp", "fp", "fn"])

    return met.mapInArrow(run, "doc_id long, type string, tp long, fp long, fn long")


def prf(counts: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) of counts(type, tp, fp, fn), and a row with a null type over all."""
    total = counts.rollup("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    total = total.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return total.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def near_misses(decoys: DataFrame) -> DataFrame:
    """(type, total, false_positives, rate) of decoys(type, flagged), and a row with a null type over all."""
    return decoys.rollup("type").agg(F.count("*").alias("total"), F.count_if("flagged").alias("false_positives")).withColumn("rate", ratio(F.col("false_positives"), F.col("total")))


def truth_at(truth: DataFrame, asked: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, step, value): of each key the snapshot of the very step, else its last."""
    last = truth.groupBy(key).agg(F.max(F.struct(step, value))[value].alias("__last"))
    exact = truth.select(key, step, F.col(value).alias("__exact"), F.lit(True).alias("__hit"))
    return asked.join(exact, [key, step], "left").join(last, key, "left").select(key, step, F.when(F.col("__hit"), F.col("__exact")).otherwise(F.col("__last")).alias(value))


def matched_controls(truth: DataFrame, observed: DataFrame, least: float = 0.5) -> DataFrame:
    """(obs, truth, observed, matched): controls in order each take the first observed element left that has their tag and overlaps enough. Pairs come from a join of
    overlapping rectangles; the fold goes through those of one page only. Both sides: (obs, ord, tag, rect)."""
    side = lambda df, k: df.select("obs", F.col("ord").alias(k), F.struct("tag", "rect").alias(f"{k}_e"), "rect")
    met = geometry.overlap_join(side(truth, "c"), side(observed, "o"), "obs", "c", "o")
    met = met.join(truth.select("obs", F.col("ord").alias("c"), F.col("tag").alias("tc")), ["obs", "c"]).join(observed.select("obs", F.col("ord").alias("o"), F.col("tag").alias("to")), ["obs", "o"])
    pairs = met.where((F.col("tc") == F.col("to")) & (geometry.iou(F.col("l"), F.col("r")) >= least)).groupBy("obs").agg(F.array_sort(F.collect_list(F.struct(F.col("c").cast("long").alias("c"), F.col("o").cast("long").alias("o")))).alias("pairs"))
    step = lambda done, p: F.when(F.exists(done, lambda d: (d["c"] == p["c"]) | (d["o"] == p["o"])), done).otherwise(F.array_append(done, p))
    taken = pairs.select("obs", F.size(F.aggregate("pairs", F.array().cast("array<struct<c:bigint,o:bigint>>"), step)).cast("long").alias("matched"))
    count = lambda df, name: df.groupBy("obs").agg(F.count("*").alias(name))
    out = count(truth, "truth").join(count(observed, "observed"), "obs", "full").join(taken, "obs", "left")
    return out.select("obs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("truth", "observed", "matched")])


def justified(redactions: DataFrame, truth: DataFrame, least: float = 0.3, slack: int = 4) -> DataFrame:
    """redactions(obs, id, rect, reason) with justified: does it cover what truth(obs, tid, kind, rect) shows, lie inside a field, or was it for pixels that can't be read?"""
    a, b = F.col("l"), F.col("r")
    around = lambda x, y: geometry.contains(geometry.rect(x["x"] - slack, x["y"] - slack, x["w"] + 2 * slack, x["h"] + 2 * slack), y)
    met = geometry.overlap_join(redactions.select("obs", "id", "rect"), truth.select("obs", "tid", "rect"), "obs", "id", "tid").join(truth.select("obs", "tid", "kind"), ["obs", "tid"])
    good = met.where((geometry.iou(a, b) >= least) | around(a, b) | ((F.col("kind") == "field") & around(b, a))).select("obs", "id").distinct().withColumn("__good", F.lit(True))
    opaque = F.lower("reason").rlike("canvas|img|iframe|svg|video|unexplained|no dom owner")
    return redactions.join(good, ["obs", "id"], "left").withColumn("justified", F.coalesce("__good", F.lit(False)) | opaque).drop("__good")


def floor_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each share): the value at floor(n * share), the last at most, of each key's sorted values. Equal values are counted first, and running counts pick
    the place, so no key's values are gathered in an array. Rows without a key are one of their own."""
    per = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    upto, n = F.sum("c").over(W.partitionBy(key).orderBy(value)), F.sum("c").over(W.partitionBy(key))
    ranked = per.select(key, value, upto.alias("upto"), n.alias("n"))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()])


def ablated(terms: DataFrame, weights: dict[str, float], configs: dict[str, dict[str, float]], tokenize: float) -> DataFrame:
    """(config, channel, n, found, recall) of terms(obs, anchor, channel, type, confidence): how many anchors each configuration of source weights would still act on, by channel and,
    with a null one, over all."""
    config = F.explode(F.array(*[F.struct(F.lit(k).alias("config"), *[F.lit(float(c.get(t, w))).alias(t) for t, w in weights.items()]) for k, c in configs.items()])).alias("c")
    weight = F.coalesce(*[F.when(F.col("type") == t, F.col(f"c.{t}")) for t in weights])
    kept = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight * F.col("confidence")))
    score = terms.select("*", config).groupBy("c.config", "obs", "anchor").agg(F.first("channel").alias("channel"), F.round(1 - F.product(kept), 9).alias("s"))
    total = score.groupingSets([["config", "channel"], ["config"]], "config", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= tokenize).alias("found"))
    return total.select("config", "channel", "n", "found", (F.col("found") / F.col("n")).alias("recall"))
