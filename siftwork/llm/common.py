"""What the training-data operators share: reading, cutting lineage, components."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.tables import cut, drop, mark, new_path, shared_dir, sweep

__all__ = ["cut", "drop", "mark", "new_path", "shared_dir", "sweep"]

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key's rows are dealt into parts where it has more than one in PARTS of all rows, and more than LEAST.
PARTS, LEAST = 10_000, 512


def spread_join(many: DataFrame, one: DataFrame, key: str, n: int, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """many.join(one, key), where any share of many's rows may have the same key. `one` has a row for each key at most, n is the
    number of many's rows and sizes(key, n) counts them by key.

    Keys of more rows than a limit, PARTS of them at most, which is what bounds the broadcast, are dealt into parts, and their row of `one` is repeated for each part.
    Rows with a null key are dealt out as well; a left join keeps them.
    """
    limit = max(LEAST, n // PARTS)
    heavy = F.broadcast(sizes.where(F.col("n") > limit).select(F.col(key).alias("__heavy"), F.ceil(F.col("n") / limit).cast("long").alias("__parts")))
    dealt = F.pmod(F.xxhash64(*many.columns), F.coalesce("__parts", F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(F.lit(1)).cast("long")))
    left = many.join(heavy, F.col(key) == F.col("__heavy"), "left").select(*many.columns, dealt.alias("__part"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1).cast("long")) - 1))
    right = one.join(heavy, F.col(key) == F.col("__heavy"), "left").select(*one.columns, each.alias("__part"))
    return left.join(right, [key, "__part"], how).drop("__part")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the files give fewer partitions than there are cores (small inputs only)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small(batches, rows: int = 256):
    """Arrow batches in slices, so that a worker never holds what it makes of very many long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(batches, column: str, rows: int, size: int):
    """Arrow batches in slices of at most so many rows and bytes in a column, or of one longer row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            upto = min(max(upto, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that it reaches.

    Alternating star contraction (Kiveris et al. 2014): each pass is an aggregation of a minimum and a join, so that a
    node with very many neighbours is pre-aggregated and its rows are dealt into parts; no group is gathered. Nodes without edges are not returned.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low.drop("n"), "a", 2 * now.count(), low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = cut(small, name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
