"""Ordered events of a session: repeats, streaks, quiet gaps and rate limits."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema


def loops(events: DataFrame, session: str, order: list[str], action: str, run: int = 3) -> DataFrame:
    """events with looped: this action and the run - 1 before it are the same."""
    w = W.partitionBy(session).orderBy(*order)
    same = F.lit(True)
    for k in range(1, run):
        same = same & F.coalesce(F.col(action) == F.lag(action, k).over(w), F.lit(False))
    return events.withColumn("looped", same)


def streaks(events: DataFrame, session: str, order: list[str], failed: str) -> DataFrame:
    """events with streak: failures in a row up to this event, 0 after a success."""
    w = W.partitionBy(session).orderBy(*order)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumn("__island", island)
    inside = W.partitionBy(session, "__island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(F.col(failed).cast("long")).over(inside)).drop("__island")


def quiet(events: DataFrame, session: str, time: str, gap: str) -> DataFrame:
    """(session, start, end, n): stretches of events with no gap as long as `gap` between them."""
    found = events.groupBy(session, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limit(events: DataFrame, session: str, millis: str, order: str, window: int = schema.RATE_WINDOW_MS, most: int = schema.RATE_MAX_SENDS, counts: str | None = None) -> DataFrame:
    """(session, order, accepted): at most `most` accepted in the trailing window; one exactly the window's length old still counts, refused ones don't, nor do
    those whose column `counts` is false. The history decides, so sessions are gone through in order, as a stream of sorted rows: what is held is `most` times."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(frames):
        now_in, kept = object(), deque()
        for pdf in frames:
            out = []
            for who, now, recorded in zip(pdf[session], pdf[millis], pdf["__counts"], strict=True):
                who = None if pd.isna(who) else who  # sessions that are null are one, though pandas has numbers that don't equal themselves for them
                if who != now_in:
                    now_in, kept = who, deque()
                while kept and now - kept[0] > window:
                    kept.popleft()
                out.append(len(kept) < most)
                if out[-1] and recorded:
                    kept.append(now)
            yield pdf[[session, order]].assign(accepted=out)

    rows = events.select(session, millis, order, (F.col(counts) if counts else F.lit(True)).alias("__counts"))
    return rows.repartition(session).sortWithinPartitions(session, millis, order).mapInPandas(run, f"{session} {kinds[session]}, {order} {kinds[order]}, accepted boolean")


def expired(events: DataFrame, session: str, time: str, ttl_ms: int = schema.SESSION_TTL_MS) -> DataFrame:
    """events with expired: is the event later than its session's first one by more than the time to live? Age counts from creation, not from use."""
    begun = events.groupBy(session).agg(F.min(time).alias("__begun"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return events.join(begun, session).withColumn("expired", ms(time) - ms("__begun") > ttl_ms).drop("__begun")


def cart(ops: DataFrame, cart: str, item: str, at: str, quantity: str) -> DataFrame:
    """(cart, item, quantity) after ops in the order of `at`: one more where quantity is null, else that many; none or less deletes. No session is gone
    through in order: the last setting of each item and the additions behind it decide."""
    last = ops.where(F.col(quantity).isNotNull()).groupBy(cart, item).agg(F.max(at).alias("__at"), F.max_by(quantity, at).alias("__set"))
    later = F.col(quantity).isNull() & (F.col("__at").isNull() | (F.col(at) > F.col("__at")))
    both = ops.join(last, [cart, item], "left").groupBy(cart, item).agg(F.count_if(later).alias("more"), F.max("__set").alias("set"))
    return both.select(cart, item, (F.greatest(F.coalesce("set", F.lit(0)), F.lit(0)) + F.col("more")).cast("long").alias("quantity")).where("quantity > 0")


def store(ops: DataFrame) -> DataFrame:
    """(space, key, value) that a store holds after ops(space, key, at, op, value) of put, delete and clear, which empties its own space only."""
    cleared = ops.where("op = 'clear'").groupBy("space").agg(F.max("at").alias("__at"))
    live = ops.where("op <> 'clear'").join(cleared, "space", "left").where("__at IS NULL OR at > __at")
    last = live.groupBy("space", "key").agg(F.max_by("op", "at").alias("op"), F.max_by("value", "at").alias("value"))
    return last.where("op = 'put'").select("space", "key", "value")


def seeded_orders(seeds: DataFrame, seed: str) -> DataFrame:
    """(seed, id, tracking, status, placed_ms): three orders for each seed."""
    made = [(1, "Delivered", 12), (2, "Shipped", 3), (3, "Processing", 1)]
    orders = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(status).alias("status"), F.lit(days).alias("days")) for n, status, days in made])
    s, n = F.col(seed), F.col("o.n")
    placed = F.unix_millis(F.lit("2026-08-20T00:00:00Z").cast("timestamp")) - F.col("o.days") * F.lit(86_400_000).cast("long")
    rows = seeds.select(seed, F.explode(orders).alias("o"))
    return rows.select(seed, F.concat(F.lit("ORD-"), s.cast("string"), F.lpad(n.cast("string"), 3, "0")).alias("id"), F.concat(F.lit("TRK"), ((s * 7919 + n * 104729) % 100000000).cast("string")).alias("tracking"), "o.status", placed.alias("placed_ms"))


def patient_seed(base: Column, patient: Column) -> Column:
    """A seed of its own for each known patient; unknown ones share the first's."""
    return base + F.greatest(F.array_position(F.array(F.lit("P001"), F.lit("P002"), F.lit("P003")), patient) - 1, F.lit(0))
