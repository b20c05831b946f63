"""What is sent to all tasks passes through the driver: rectangles of pages and values of many sessions, whose files are far smaller than they are, meet by shuffles."""

import random
import re

from pyspark.sql import functions as F

from siftwork.operators import fusion, geometry, observe, session
from siftwork.plans import observation

PAIR = "obs int, {} int, x double, y double, w double, h double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_pages_are_those_of_cells(spark):
    r = random.Random(5)
    at = lambda: float(r.randint(-200, 300))
    frame = lambda i: spark.createDataFrame([(n % 4, n, at(), at(), float(r.choice([0, 5, 64, 300])), float(r.choice([0, 5, 64, 300]))) for n in range(80)], PAIR.format(i)).select("obs", i, geometry.rect("x", "y", "w", "h").alias("rect"))
    a, b = frame("i").cache(), frame("j").cache()
    rows = lambda pages: sorted(map(repr, geometry.overlap_join(a, b, "obs", "i", "j", pages=pages).collect()))
    assert rows(True) == rows(False) and len(rows(True)) > 100


def test_regions_are_not_sent_to_all_tasks(spark, tmp_path):
    n = F.col("id")
    rect = geometry.rect(n % 9 * 100, F.lit(0), F.lit(90), F.lit(400))
    spark.range(500).select((n % 50).alias("obs"), n.alias("ord"), F.lit("regex").alias("type"), F.lit("EMAIL").alias("pii_type"), F.lit(0.9).alias("confidence"), rect.alias("rect")).write.parquet(f"{tmp_path}/seen")
    spark.range(50).select(n.alias("obs"), n.alias("ord"), rect.alias("rect"), F.lit("opaque").alias("reason")).write.parquet(f"{tmp_path}/odd")
    out = fusion.fuse(spark.read.parquet(f"{tmp_path}/seen"), spark.read.parquet(f"{tmp_path}/odd"), "BALANCED")
    assert "BroadcastHashJoin" not in plan_of(out) and out.count() > 50


def test_observations_send_no_rectangles_to_all_tasks(spark, sf_dir):
    made = observation.sanitized(spark, sf_dir)
    for df in (made.elements, made.texts, made._marked, made._regions):
        joins = re.findall(r"BroadcastHashJoin \[(.*?)\]", plan_of(df))
        assert not [j for j in joins if "cx#" in j or "region#" in j]
    assert isinstance(made, observe.Sanitized)


def test_values_of_many_sessions_are_not_sent_to_all_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(s, n, f"to A{s}@zmail.in and b{n}@zmail.in") for s in "pqr" for n in range(4)] + [(None, 9, "ap@zmail.in")], "session string, id int, text string")
    known = spark.createDataFrame([(s, f"a{s}@zmail.in", f"⟦EMAIL#{i}⟧") for i, s in enumerate("pqr")] + [(None, "ap@zmail.in", "⟦EMAIL#7⟧")], "session string, key string, handle string")
    one = lambda: session.substitute_known(rows, "text", known, ["id"])
    want = sorted(map(repr, one().collect()))
    monkeypatch.setattr(session, "SENT", 3, raising=False)
    out = one()
    assert "Broadcast" not in plan_of(out) and sorted(map(repr, out.collect())) == want
    assert sum("⟦EMAIL#" in w for w in want) == 13
