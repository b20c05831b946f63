"""Runs without a name and runs of which nothing was measured: as the SQL has them."""

import duckdb
from pyspark.sql import functions as F

from siftwork.operators import metrics
from siftwork.plans import wire


def test_runs_without_a_name_or_a_measure(spark, tmp_path):
    i = F.col("id")
    kind = F.when(i % 7 == 0, None).when(i % 3 == 0, "click").otherwise("view")
    events = spark.range(300).select(i.alias("event_id"), F.when(i % 4 > 0, i % 4).alias("user_id"), kind.alias("event_type"), F.when((i % 4 != 2) & (i % 11 > 0), (i % 17 + 1).cast("double")).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(wire.ORACLES["run_resources"]).fetchall(), key=repr)
    got = sorted(map(tuple, wire.run_resources(spark, str(tmp_path)).select("run", "steps", "local_ms", "bytes_p50").collect()), key=repr)
    assert got == want and [r[2] for r in got if r[0] == 2] == [None] and [r[3] > 0 for r in got if r[0] is None] == [True]


def test_percentiles_of_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (None, 2), ("a", 5)], "k string, v int")
    assert {(r.k, r.p50) for r in metrics.floor_percentiles(df, "k", "v", {"p50": 0.5}).collect()} == {(None, 2), ("a", 5)}
