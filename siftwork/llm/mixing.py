"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a size (its words) and a 32-bit hash of its id. A source's target is met by whole copies of all its
documents plus those whose hash is below a threshold. The threshold comes from sums by source and hash bucket: the bucket
in which the budget ends is the only one that the next, finer histogram looks into. No rows are sorted, and no source's rows
meet in one task: the sums are pre-aggregated in every task.

Null texts have size 0; a null source is a source of its own, last in order; sources without words have target 0 and nothing
taken. Rows that share an id are kept or left together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Bits of the hash that each histogram adds; together 32.
LEVELS = (12, 10, 10)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """The first 32 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from sizes(source, size): shares of all words by weight, at most `most` times the source's size.

    With sources ordered by limit / weight, those that are capped come first; the others share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", pick.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    by = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.select("*", left.alias("left"), share.alias("share"), F.row_number().over(by).alias("nth"))
    free = F.col("left") * F.col("weight") < F.col("limit") * F.col("share")
    first = F.min(F.when(free, F.struct("nth", "left", "share"))).over(whole)
    target = F.when(F.col("nth") >= F.coalesce(first["nth"], F.lit(2**31 - 1)), first["left"] * F.col("weight") / first["share"]).otherwise(F.col("limit").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, below): each document is taken copies times, and once more if its hash is under below.

    sizes(source, size, hash) is read once for each level. What is carried from level to level is one row for each source.
    """
    empty = F.col("source_size") <= 0
    copies = F.when(empty, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    state = goals.select("*", copies.alias("copies")).select("*", F.when(empty, 0.0).otherwise(F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("sum_below"))
    state, done = cut(state, "mix-level"), 0
    for bits in LEVELS:
        done += bits
        bucket = F.shiftright("hash", 32 - done)
        kept = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        inside = sizes.join(kept, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", 32 - done + bits) == F.col("p")), "left_semi")
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = W.partitionBy("source").orderBy("bucket")
        sums = sums.select(F.col("source").alias("s"), "bucket", "words", F.sum("words").over(upto).alias("upto"))
        met = sums.join(state, F.col("s").eqNullSafe(F.col("source"))).where(F.col("sum_below") + F.col("upto") > F.col("rest"))
        first = met.groupBy("s").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        state = state.join(first, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "copies", "rest",
            F.coalesce("b.bucket", F.shiftleft("prefix", bits)).alias("prefix"),
            (F.col("sum_below") + F.coalesce(F.col("b.upto") - F.col("b.words"), F.lit(0))).alias("sum_below"),
            F.coalesce("b.words", F.lit(0)).alias("at"),
        )
        state = cut(state, "mix-level")
    # the last bucket is one hash value: with it or without it, whichever is nearer
    nearer = (F.col("rest") - F.col("sum_below")) * 2 > F.col("at")
    return cut(state.select("source", "source_size", "target", "copies", (F.col("prefix") + F.when(nearer & (F.col("at") > 0), 1).otherwise(0)).alias("below")), "mix-state")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(id_col, size long, source_size long, target double, taken long) for every row."""
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("hash")), "mix-sizes")
    state = thresholds(sizes, targets(sizes, weights, most)).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    return sizes.join(state, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: docs' own columns, each row as many times as it is taken."""
    sizes = cut(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("hash")), "mix-sizes")
    state = thresholds(sizes, targets(sizes, weights, most)).select(F.col("source").alias("__mix_s"), F.col("copies").alias("__mix_c"), F.col("below").alias("__mix_b"))
    times = (F.col("__mix_c") + F.when(hash_of(F.col(id_col)) < F.col("__mix_b"), 1).otherwise(0)).cast("int")
    rows = docs.join(state, F.col(source_col).eqNullSafe(F.col("__mix_s")))
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("__mix_n")).select(*docs.columns)


#: DuckDB SQL for mix() over documents, with the default weights. md5 gives the same first 32 bits there.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER w AS nth, (SELECT sum(size) FROM d)::BIGINT - coalesce(sum(3 * source_size) OVER p, 0)::BIGINT AS lft,
         (SELECT sum(weight) FROM s)::BIGINT - coalesce(sum(weight) OVER p, 0)::BIGINT AS share
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST), p AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT nth AS f_nth, lft AS f_lft, share AS f_share FROM o WHERE lft * weight < 3 * source_size * share ORDER BY nth LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN nth >= coalesce(f_nth, 2147483647) THEN (f_lft * weight)::DOUBLE / f_share ELSE (3 * source_size)::DOUBLE END AS target FROM o LEFT JOIN f ON true
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t
), k AS (
  SELECT d.doc_id, d.source, size, h, source_size, target, copies, CASE WHEN source_size > 0 THEN target - copies * source_size ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN upto <= rest OR (upto - same <= rest AND (rest - (upto - same)) * 2 > same) THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""
