"""Spans found in Arrow tasks against the columns' own search."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import recognize, seek
from siftwork.plans.probes import VECTORS

ODD = [
    None, "", "@", "a@b.com.x@c.com", "a@b.com@d.com,e@f.co.uk", ".a@b.com", "--@b.com a@b.test", "é_a@b.com aé@b.com", "user@@domain.com", "x" * 300 + "@okaxis", "ab.-@paytm-ab@paytm_", "😀9876543210 é9876543210", "a9876543210 9876543210b 98765432109876543210",
    "::1", "x ::1 fe80::1::2 1:2:3::", "sk_abcdefghijklmnop", "sk_abcdefghijklmno sk_abcdefghijklmnopé", "4532015112830366-4532015112830366", "1.2.3.4 1.2.3.4.5 256.1.1.1 01.2.3.4", "born 1990-01-151 born 1990-01-15", "234567890124 2345-6789-0124x",
    "+919876543210+91 9876543210 +1 2071234567", "a@b.com" * 40, "pan:ABCDE1234F_ABCDE1234F ABCDE1234F",
]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    pieces = [w for v in VECTORS for w in v.split(" ")] + ["é", "😀", "@", "-", ".", "+91 ", "9876543210", "_", "\n", "born ", "order ", "::", "1:", "a@b.com"]
    made = ["".join(r.choice(pieces) + r.choice(["", " ", ",", "x"]) for _ in range(r.randint(1, 40))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(ODD + list(VECTORS) + made)), "i long, text string").cache()


@pytest.mark.parametrize("name", list(recognize.RECOGNIZERS))
def test_finds_what_the_columns_find(texts, name):
    rows = texts.select("i", recognize.recognize(F.col("text"), (name,)).alias("got"), F.coalesce(recognize.RECOGNIZERS[name](F.col("text")), F.array().cast(recognize.SPANS)).alias("want")).collect()
    assert [(r.i, r.got) for r in rows] == [(r.i, r.want) for r in rows] and any(r.got for r in rows)


def test_texts_are_looked_through_outside_the_columns(texts):
    """One Arrow step for all names, and no pattern over the whole text in the plan."""
    plan = recognize.detect(texts, "i", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "regexp_extract_all(text" not in plan


def test_shortest_prefixed_key(spark):
    """19 characters, which the hint asked to be 20."""
    rows = spark.createDataFrame([("key sk_abcdefghijklmnop",), ("sk_abcdefghijklmno",)], "t string")
    assert [[s.value for s in r.s] for r in rows.select(recognize.recognize(F.col("t"), ("secret",)).alias("s")).collect()] == [["sk_abcdefghijklmnop"], []]


def test_bytes_that_are_no_text_fail_no_task(spark):
    rows = spark.range(1).select(F.concat(F.unhex(F.lit("ff")).cast("string"), F.lit(" user@zmail.in")).alias("t"))
    assert [s.value for s in rows.select(recognize.recognize(F.col("t"), ("email",)).alias("s")).first().s] == ["user@zmail.in"]


def test_long_runs_end():
    for text in ("a." * 200_000 + "@b.com", "a@" * 100_000, "a" * 400_000, "1:" * 100_000 + "::"):
        for name in recognize.RECOGNIZERS:
            seek.spans_of(name, text)
