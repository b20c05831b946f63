"""As-of joins: the latest state not after a moment; and what hangs on it, truth by step and the elements of the current observation.

Both sides are put in one table, ordered by key and time, and cut into blocks of neighbouring rows, so that a key of any share of all rows lies in many. A block's last state is
carried into the key's later blocks by a window over blocks, of which there are few; inside a block a running last value does the rest. No pair of rows of both sides is made.

Rows with a null key or time have no state. States of one key and time are one, the largest. Repeated rows of the left side are kept; extra columns of the left side stay, those of the right side
that aren't asked for are ignored. Empty sides give nulls or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork.tables import cut


def asof(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], blocks: int | None = None) -> DataFrame:
    """left with the values, and __since, the time, of the right row of its key that is the latest at or before its time; nulls where there is none."""
    spark = left.sparkSession
    blocks = blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mine = F.struct(*left.columns).alias("__row")
    asked = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), mine, F.lit(None).cast(right.select(F.struct(F.col(at).alias("__since"), *values).alias("s")).schema["s"].dataType).alias("__state"))
    state = F.struct(F.col("__at").alias("__since"), *[F.col("__v")[v].alias(v) for v in values])
    said = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(at).alias("__at")).agg(F.max(F.struct(*values)).alias("__v"))
    said = said.select("__key", "__at", F.lit(0).alias("__side"), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), state.alias("__state"))
    # the block's number is written with its rows: it must not change between the two reads below
    rows = cut(asked.unionByName(said).repartitionByRange(blocks, "__key", "__at", "__side").withColumn("__block", F.spark_partition_id()), "asof")
    last = rows.where("__side = 0").groupBy("__key", "__block").agg(F.max_by("__state", "__at").alias("__last"))
    carried = last.unionByName(rows.select("__key", "__block").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType))).groupBy("__key", "__block").agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = W.partitionBy("__key").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select("__key", "__block", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    inside = W.partitionBy("__key", "__block").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = rows.withColumn("__now", F.last("__state", ignorenulls=True).over(inside)).where("__side = 1")
    found = running.join(carried, running["__key"].eqNullSafe(carried["__key"]) & (running["__block"] == carried["__block"]), "left").select("__row", F.when(running["__key"].isNotNull() & running["__at"].isNotNull(), F.coalesce("__now", "__carry")).alias("__s"))
    return found.select("__row.*", *[F.col("__s")[v].alias(v) for v in ("__since", *values)])


def snapshots(steps: DataFrame, truth: DataFrame, run: str, at: str, values: list[str], max_age=None) -> DataFrame:
    """steps with the truth that was taken last, not after them, and `taken`, when; older than max_age (a column of the difference's type) counts as none."""
    found = asof(steps, truth, run, at, values).withColumnRenamed("__since", "taken")
    if max_age is None:
        return found
    fresh = F.coalesce(F.col(at) - F.col("taken") <= max_age, F.lit(False))
    return found.withColumns({v: F.when(fresh, F.col(v)) for v in ("taken", *values)})


def current(observations: DataFrame) -> DataFrame:
    """(session, observation, since, until) of observations(session, observation, at): each counts until the session's next; the last has no end."""
    nth = W.partitionBy("session").orderBy("at", "observation")
    return observations.select("session", "observation", F.col("at").alias("since"), F.lead("at").over(nth).alias("until"))


def resolve(asked: DataFrame, observations: DataFrame, elements: DataFrame) -> DataFrame:
    """asked(session, at, observation, id, ...) with current, the session's observation at that time, and status: none (nothing has been observed), stale (another observation than the one
    that was asked about is current), unknown (it has no element of that id), ok. elements(observation, id): what each observation registered. A null observation asks about the current one."""
    now = asof(asked, observations.withColumnRenamed("observation", "current"), "session", "at", ["current"]).drop("__since")
    there = elements.select(F.col("observation").alias("current"), "id").distinct().withColumn("__there", F.lit(True))
    found = now.join(there, ["current", "id"], "left")
    stale = F.col("observation").isNotNull() & (F.col("observation") != F.col("current"))
    status = F.when(F.col("current").isNull(), "none").when(stale, "stale").when(F.col("__there"), "ok").otherwise("unknown")
    return found.select(*asked.columns, "current", status.alias("status"))
