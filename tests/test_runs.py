"""Means of runs at a half: the same in any order of the steps."""

from pyspark.sql import functions as F

from siftwork.plans import wire


def test_halves_round_up_in_any_order(spark, tmp_path):
    i = F.col("id")
    events = spark.range(60_000).select(i.alias("event_id"), (i % 1000).alias("user_id"), F.lit("view").alias("event_type"), (F.pmod(F.xxhash64(i), F.lit(20_000)) / 100).alias("value"))
    cents = {r.user_id: r.c for r in events.groupBy("user_id").agg(F.sum(F.round(F.col("value") * 200).cast("long")).alias("c")).collect()}
    # a last step makes the mean of each run end in a half
    last = spark.createDataFrame([(60_000 + u, u, "view", ((-c + 3050) % 6100) / 200) for u, c in cents.items() if (-c + 3050) % 2 == 0], "event_id long, user_id long, event_type string, value double")
    want = {u: (c + (-c + 3050) % 6100 + 3050) // 6100 for u, c in cents.items() if (-c + 3050) % 2 == 0}
    for nth in range(2):
        every = events.unionByName(last).repartition(3 + nth).sortWithinPartitions(F.xxhash64("event_id", F.lit(nth)))
        every.write.parquet(f"{tmp_path}/{nth}/events.parquet")
        got = {r.run: r.local_ms for r in wire.run_resources(spark, f"{tmp_path}/{nth}").collect()}
        assert {u: got[u] for u in want} == want and len(want) > 300
