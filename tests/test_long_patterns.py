"""Recognizers on texts that repeat the inner group of a pattern: no stack is exhausted, and mail addresses are those of the plain pattern."""

import random
import re

from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import recognize


def test_long_repeats_end(spark):
    texts = ["x@" + "a." * 500_000 + "org", "1::" + "1:" * 500_000, "x@" + "a." * 2_000 + "org me@zmail.in", "1.a" * 300_000 + "@", "a" * 500_000 + "@b.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", *[F.transform(F.when(recognize._hinted(F.col("text"), n), recognize.RECOGNIZERS[n](F.col("text"))), lambda s: s["value"]).alias(n) for n in ("email", "ipv6_compressed", "ipv4")]).collect()
    by = {r.i: r for r in got}
    assert by[2].email == ["me@zmail.in"] and by[4].email == ["a" * 500_000 + "@b.org"] and not by[0].email and not by[1].ipv6_compressed


def test_mail_equals_the_plain_pattern(spark):
    r = random.Random(9)
    parts = ["a", "b1", ".", "-", "@", "com", "org", "_", " ", "é", "+", "x@y.com", ".org", "test", "co.uk", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(2_000)]
    plain = re.compile(schema.PATTERNS["email"].replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    for x in df.select("i", recognize._mails(F.col("text")).alias("s")).collect():
        assert [(s.start, s.value) for s in x.s] == [(m.start(), m[0]) for m in plain.finditer(texts[x.i])], texts[x.i]
