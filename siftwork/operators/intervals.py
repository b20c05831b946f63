"""Windows of words, joined text nodes, and spans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.functions.text import let

SIZE, OVERLAP = 512, 64


def chunk_text(rows: DataFrame, key: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, nth, offset, text): windows of `size` words that share `overlap` with the one before; a text of no more words is one window as it stands, a blank one none."""
    step = max(1, size - overlap)

    def cut(words: Column) -> Column:
        def placed(gaps: Column) -> Column:
            # running ends of gap and word in one fold over windows would be quadratic: lengths are summed window by window
            n = F.size(words)
            begins = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step)))
            length = lambda a, lo, k: F.aggregate(F.slice(a, lo + 1, k), F.lit(0), lambda s, x: s + F.length(x))

            def window(i: Column) -> Column:
                k = F.least(F.lit(size), n - i)
                start = length(gaps, F.lit(0), i + 1) + length(words, F.lit(0), i)
                width = length(gaps, i + 1, k - 1) + length(words, i, k)
                return F.struct(F.when(n <= size, 0).otherwise(start).alias("offset"), F.when(n <= size, F.length(text_col)).otherwise(width).alias("width"))

            return F.when(n == 0, F.array().cast("array<struct<offset:int,width:int>>")).otherwise(F.transform(begins, window))

        return let(F.split(text_col, r"\S+", -1), placed)

    found = rows.select(key, text_col, F.posexplode(let(F.regexp_extract_all(text_col, F.lit(r"\S+"), F.lit(0)), cut)).alias("nth", "c"))
    return found.select(key, F.col("nth").cast("long").alias("nth"), F.col("c.offset").cast("long").alias("offset"), F.col(text_col).substr(F.col("c.offset") + 1, F.col("c.width")).alias("text"))


def merge_spans(spans: Column, gap: int = 1) -> Column:
    """array<struct<start, end, type, confidence>> by start and end, each merged into the one before if that has its type and ends at most gap before it."""
    kind = "array<struct<start:int,end:int,type:string,confidence:double>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        one = lambda e, c: F.struct(last["start"].alias("start"), e.alias("end"), last["type"].alias("type"), c.alias("confidence"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one(F.greatest(last["end"], s["end"]), F.greatest(last["confidence"], s["confidence"]))))
        return F.when(F.size(done) == 0, F.array(s)).when((last["type"] == s["type"]) & (s["start"] <= last["end"] + gap), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def join_nodes(nodes: DataFrame, group: str, order: str, text_col: str, separator: str = " ") -> DataFrame:
    """(group, order, start, end): where each text lands when a group's are joined; no separator while nothing has been written."""
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    n = F.length(F.coalesce(text_col, F.lit("")))
    wrote = F.coalesce(F.sum(n).over(before), F.lit(0))
    # the first text that isn't empty opens; each node behind it costs a separator
    opened = F.coalesce(F.max((n > 0).cast("int")).over(before), F.lit(0))
    rows = nodes.select(group, order, n.alias("n"), wrote.alias("wrote"), opened.alias("opened"))
    gaps = F.sum("opened").over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) * len(separator)
    return rows.select(group, order, (F.col("wrote") + gaps).cast("long").alias("start"), (F.col("wrote") + gaps + F.col("n")).cast("long").alias("end"))


def map_spans(spans: DataFrame, ranges: DataFrame, group: str, order: str, bucket: int = 256) -> DataFrame:
    """(group, order, s_start, start, end): spans(group, start, end) cut to the ranges(group, order, start, end) that they meet, in the ranges' own offsets. Both are dealt into buckets of offsets, so long groups don't meet as a whole."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.greatest(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
    left = spans.select(group, F.col("start").alias("s0"), F.col("end").alias("s1")).withColumn("c", F.explode(cells("s0", "s1")))
    right = ranges.select(group, order, F.col("start").alias("r0"), F.col("end").alias("r1")).withColumn("c", F.explode(cells("r0", "r1")))
    met = left.join(right, [group, "c"]).where("s0 < r1 AND s1 > r0").where(F.col("c") == F.floor(F.greatest("s0", "r0") / bucket))
    return met.select(group, order, F.col("s0").alias("s_start"), (F.greatest("s0", "r0") - F.col("r0")).alias("start"), (F.least("s1", "r1") - F.col("r0")).alias("end")).where("start < end")
