"""What lies under what: rows are moved once, repeated and odd rectangles count."""

from siftwork.operators import hits

SCHEMA = "obs long, id long, ord long, end long, rect struct<x:double,y:double,w:double,h:double>"


def test_rows_are_moved_once(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, (0.0, 0.0, 8.0, 8.0))], SCHEMA)
    assert hits.occluded(df)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_odd_rectangles(spark):
    rows = [
        (1, 1, 1, 1, (0.0, 0.0, 200.0, 200.0)), (1, 1, 1, 1, (0.0, 0.0, 200.0, 200.0)), (1, 2, 2, 2, (0.0, 0.0, 300.0, 300.0)), (1, 3, 3, 3, (10.0, 10.0, 0.0, 5.0)), (1, 4, 4, 4, None),
        (1, 5, 5, 5, (63.0, 63.0, 1.0, 1.0)), (1, 6, 6, 6, (60.0, 60.0, 20.0, 20.0)), (2, 1, 1, 1, (0.0, 0.0, 200.0, 200.0)), (2, 2, 2, 2, (-5.0, -5.0, 100.0, 100.0)),
    ]
    got = {(r.obs, r.id): r.occluded for r in hits.occluded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): True, (1, 5): True, (1, 6): False, (2, 1): False, (2, 2): False}
