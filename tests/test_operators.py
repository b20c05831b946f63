"""Vectors and properties of the operators that SQL twins don't cover."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import checks
from siftwork.functions import text as T
from siftwork.operators import contain, fusion, geometry, intervals, metrics, recognize, session, sessions
from siftwork.streaming import sessions as streams

VECTORS = {
    "email": (["user@zmail.in", "user+tag@sub.sample.co.uk", "a@b.co", "x@mail5.example.com"], ["user@domain", "user@-domain.com", "user@@domain.com", "user@example.com", "a@b.test"]),
    "phone_in_e164": (["+91 9876543210", "+91 99194 14773"], ["+91 5876543210", "1+91 9876543210"]),
    "phone_in_bare": (["9876543210"], ["5876543210", "98765432101"]),
    "phone_generic": (["+44 2071234567"], ["+91 9876543210", "44 2071234567"]),
    "aadhaar": (["234567890124", "999999999999", "111111111115", "2345 6789 0124"], ["234567890123", "1234567890123", "prefix234567890124suffix"]),
    "pan": (["ABCDE1234F", "PQRST9012Z"], ["PRODU1234X", "ABCDE0000F", "abcde1234f"]),
    "ifsc": (["SBIN0001234", "UTIB0003456"], ["XXXX0001234", "SBIN1234567", "sbin0001234"]),
    "gstin": (["29ABCDE1234F1Z3", "27PQRST5678G2ZV"], ["29ABCDE1234F1ZX", "00ABCDE1234F1Z5"]),
    "upi": (["rahul.123@okhdfcbank", "user@phonepe"], ["user@paytm.com", "ab@paytm", "user@okhdfc"]),
    "card": (["4532015112830366", "5555555555554444", "378282246310005"], ["4532015112830367", "4242424242424242", "Order ID: 4532015112830366"]),
    "ipv4": (["192.168.1.1"], ["256.1.1.1", "1.2.3.4.5"]),
    "ipv6_full": (["2001:0db8:85a3:0000:0000:8a2e:0370:7334"], ["gggg::1"]),
    "ipv6_compressed": (["fe80::1", "::1"], ["gggg::1"]),
    "dob_iso": (["Date of birth: 1990-01-15", "Date of birth: 2000/12/25"], ["DOB: 1990-02-30", "DOB: 2030-01-15", "1899-12-31", "1990-01-15"]),
    "dob_us": (["dob 01/25/1990"], ["dob 02/03/1991"]),
    "secret": (["sk_live_abcdEFGH12345678", "QmFzZTY0VGV4dFdpdGhIaWdoRW50cm9weQ19"], ["demo_abcdEFGH12345678ijklmnop", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]),
}


@pytest.mark.parametrize("name", sorted(VECTORS))
def test_recognizer(spark, name):
    good, bad = VECTORS[name]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad] + [("é" + t + "é" if name in ("aadhaar", "pan", "card") else t, 1) for t in good] + [(None, 0), ("", 0)]
    df = spark.createDataFrame(rows, "text string, n int")
    got = [(r.text, r.n, r.found) for r in df.select("*", F.size(recognize.RECOGNIZERS[name](F.col("text"))).alias("found")).collect()]
    assert [x for x in got if x[1] != x[2]] == []


def test_spans_have_code_point_offsets(spark):
    text = "é😀 1.2.3.4, ü 10.20.30.40\n9.9.9.9"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(recognize.ipv4(F.col("t"))).alias("s")).select("s.*").collect()
    assert [text[r.start : r.end] for r in got] == [r.value for r in got] == ["1.2.3.4", "10.20.30.40", "9.9.9.9"]


def test_check_digits(spark):
    r = random.Random(1)
    fronts = [("".join(r.choice("0123456789") for _ in range(11)),) for _ in range(50)]
    df = spark.createDataFrame(fronts, "d string")
    both = lambda digit, ok: df.select(ok(F.concat("d", digit(F.col("d")).cast("string"))).alias("ok")).where("NOT ok").count()
    assert both(checks.verhoeff_digit, checks.verhoeff_ok) == 0 and both(checks.luhn_digit, checks.luhn_ok) == 0
    e = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("abcdefgh",)], "s string").select(checks.shannon(F.col("s")).alias("h")).collect()
    assert [round(x.h, 9) for x in e] == [1.0, 0.0, 0.0, 3.0]


def test_encodings(spark):
    got = spark.createDataFrame([("a/b'c é",)], "s string").select(T.encodings(F.col("s")).alias("e")).first().e
    assert got == ["a/b'c é", "a%2fb'c%20%c3%a9", "a%252fb'c%2520%25c3%25a9", "ys9ij2mgw6k=", "ys9ij2mgw6k", "612f62276320e9", "&#97;&#47;&#98;&#39;&#99;&#32;&#233;", "a&#x2f;b&apos;c é", "".join(f"\\\\u{ord(c):04x}" for c in "a/b'c é")]
    nfkc = T.normalize_any()
    assert spark.createDataFrame([("ﬁ Ａ b",), (None,)], "s string").select(nfkc(F.col("s")).alias("n")).collect()[0].n == "fi a b"


def test_search_finds_overlapping_places(spark):
    texts = spark.createDataFrame([(1, "abababab.+*\\E abababab"), (2, "nothing"), (3, None), (4, "")], "id long, text string")
    patterns = spark.createDataFrame([("ababab",), ("ab.+*\\E",), ("short",)], "pattern string")
    got = sorted((r.id, r.pattern, r.start, r.end) for r in contain.search(texts, patterns).collect())
    assert got == [(1, "ab.+*\\E", 6, 13), (1, "ababab", 0, 6), (1, "ababab", 2, 8), (1, "ababab", 14, 20), (1, "ababab", 16, 22)]


def test_overlap_join_meets_each_pair_once(spark):
    r = random.Random(2)
    make = lambda n: [(i % 3, i, float(r.randint(-200, 300)), float(r.randint(-200, 300)), float(r.choice([0, 5, 64, 300])), float(r.choice([0, 5, 64, 300]))) for i in range(n)]
    a, b = make(60), make(60)
    frame = lambda rows, i: spark.createDataFrame(rows, f"obs int, {i} int, x double, y double, w double, h double").select("obs", i, geometry.rect("x", "y", "w", "h").alias("rect"))
    got = sorted((g.obs, g.i, g.j) for g in geometry.overlap_join(frame(a, "i"), frame(b, "j"), "obs", "i", "j").collect())
    hit = lambda p, q: p[2] < q[2] + q[4] and p[2] + p[4] > q[2] and p[3] < q[3] + q[5] and p[3] + p[5] > q[3]
    assert got == sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and hit(p, q))
    plan = geometry.overlap_join(frame(a, "i"), frame(b, "j"), "obs", "i", "j")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fusion_examples(spark):
    one = lambda kind, c, n=0: (1, n, kind, "EMAIL", c, 0.0, 0.0, 16.0, 16.0)
    schema = "obs int, ord long, type string, pii_type string, confidence double, x double, y double, w double, h double"

    def run(seen, odd, profile):
        d = spark.createDataFrame(seen, schema).withColumn("rect", geometry.rect("x", "y", "w", "h"))
        u = spark.createDataFrame(odd, "obs int, ord long, x double, y double, w double, h double, reason string").withColumn("rect", geometry.rect("x", "y", "w", "h"))
        return [(round(r.sensitivity, 5), r.action, r.source) for r in fusion.fuse(d, u, profile).collect()]

    assert run([one("vision", 0.4)], [], "STRICT") == [(0.2, "PASS", "vision")]
    assert run([one("vision", 0.4), one("ocr", 0.4, 1), one("ner", 0.4, 2)], [], "STRICT") == [(0.65184, "MASK", "ner")]
    canvas = [(1, 1, 0.0, 0.0, 16.0, 16.0, "opaque canvas")]
    assert run([], canvas, "STRICT") == [(0.8, "DROP", "deterministic")] and run([], canvas, "BALANCED") == [(0.4, "TOKENIZE", "deterministic")]
    assert run([(1, 0, "regex", "PASSWORD", 0.05, 0.0, 0.0, 8.0, 8.0)], [], "STRICT") == [(0.05, "VAULT_ONLY", "regex")]


def test_merge_spans(spark):
    r = random.Random(3)
    rows = []
    for _ in range(60):
        s = [(a := r.randint(0, 40), a + r.randint(1, 8), r.choice("AB"), round(r.random(), 3)) for _ in range(r.randint(0, 8))]
        rows.append((s,))
    got = spark.createDataFrame(rows, "s array<struct<start:int,end:int,type:string,confidence:double>>").select("s", intervals.merge_spans(F.col("s")).alias("m")).collect()
    for g in got:
        want = []
        for x in sorted(map(tuple, g.s)):
            if want and want[-1][2] == x[2] and x[0] <= want[-1][1] + 1:
                want[-1] = (want[-1][0], max(want[-1][1], x[1]), x[2], max(want[-1][3], x[3]))
            else:
                want.append(x)
        assert [tuple(x) for x in g.m] == want


def test_span_matching_is_greedy(spark):
    p = spark.createDataFrame([(1, 0, 0, 10, "A"), (1, 1, 0, 10, "A"), (1, 2, 20, 30, "B"), (2, 0, 0, 5, "A")], "doc_id long, ord int, start int, end int, type string")
    g = spark.createDataFrame([(1, 0, 0, 10, "A"), (1, 1, 21, 29, "B"), (1, 2, 40, 50, "C")], p.schema)
    got = sorted((r.doc_id, r.type, r.tp, r.fp, r.fn) for r in metrics.matched(p, g).collect())
    assert got == [(1, "A", 1, 1, 0), (1, "B", 1, 0, 0), (1, "C", 0, 0, 1), (2, "A", 0, 1, 0)]
    total = {r.type: r for r in metrics.prf(metrics.matched(p, g)).collect()}
    assert total["A"].precision == pytest.approx(1 / 3) and total["C"].f1 == 0.0 and total[None].tp == 2


def test_substitution_is_longest_first(spark):
    pairs = [("Ann", "⟦N#2⟧"), ("Ann Lee", "⟦N#1⟧"), ("ab", "⟦X#3⟧"), ("$1\\E", "⟦N#4⟧")]
    df = spark.createDataFrame([("ann lee, Ann Lee, Ann ab $1\\E", pairs), (None, pairs), ("", [])], "t string, p array<struct<value:string,handle:string>>")
    got = [r.s for r in df.select(session.substitute(F.col("t"), F.col("p")).alias("s")).collect()]
    assert got == ["⟦N#2⟧ lee, ⟦N#1⟧, ⟦N#2⟧ ab ⟦N#4⟧".replace("⟦N#2⟧ lee", "ann lee"), None, ""]


def test_bindings(spark):
    cases = [("EMAIL", ["EMAIL"], True), ("SECRET", ["PASSWORD"], True), ("PASSWORD", ["EMAIL"], False), ("CITY", [], True), ("EMAIL", [], False), ("CARD", ["CREDIT_CARD"], True), ("city", ["ADDRESS"], True)]
    df = spark.createDataFrame(cases, "k string, a array<string>, want boolean")
    assert df.where(session.binding_allowed(F.col("k"), F.col("a")) != F.col("want")).count() == 0
    assert [r.k for r in spark.createDataFrame([("⟦EMAIL#3⟧",), ("⟦PASSWORD⟧",), ("x",)], "h string").select(session.handle_kind(F.col("h")).alias("k")).collect()] == ["EMAIL", "PASSWORD", "NONE"]


def history(seed, n=300):
    r = random.Random(seed)
    return [(r.choice("ab"), i, 1000 * i // 3 + r.randint(0, 200)) for i in range(n)]


def accepted(rows, window, most):
    out, kept = {}, {}
    for s, i, ms in sorted(rows, key=lambda x: (x[2], x[1])):
        k = kept.setdefault(s, [])
        ok = sum(ms - t <= window for t in k) < most
        out[i] = ok
        if ok:
            k.append(ms)
    return out


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rows = history(4)
    want = accepted(rows, 5000, 4)
    df = spark.createDataFrame(rows, "session string, event_id long, ms long")
    batch = sessions.rate_limit(df.withColumnRenamed("session", "s"), "s", "ms", "event_id", 5000, 4)
    assert {r.event_id: r.accepted for r in batch.collect()} == want
    order = sorted(rows, key=lambda x: (x[2], x[1]))
    for k in range(3):
        spark.createDataFrame(order[k * 100 : k * 100 + 100], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = streams.rate_limit(source, 5000, 4).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.sql("SELECT * FROM limited").collect()} == want


def test_handles_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice("ab"), i, f"v{r.randint(0, 20)}", *r.choice([("EMAIL", 2), ("SECRET", 1)])) for i in range(120)]
    df = spark.createDataFrame(rows, "session string, ord long, key string, type string, tier int")
    batch = {(x.session, x.key, x.handle) for x in session.numbered(df.withColumnRenamed("key", "value")).collect()}
    for k in range(2):
        df.where(f"ord >= {k * 60} AND ord < {k * 60 + 60}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = streams.handles(source).writeStream.format("memory").queryName("handled").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(x.session, x.key, x.handle) for x in spark.sql("SELECT * FROM handled").collect()} == batch


def test_area_union(spark):
    r = random.Random(7)
    rows = [([(float(r.randint(0, 8)), float(r.randint(0, 8)), float(r.randint(0, 4)), float(r.randint(0, 4))) for _ in range(r.randint(0, 6))],) for _ in range(40)]
    got = spark.createDataFrame(rows, "r array<struct<x:double,y:double,w:double,h:double>>").select("r", geometry.area_union(F.col("r")).alias("a")).collect()
    for g in got:
        cells = {(i, j) for x in g.r for i in range(int(x.x), int(x.x + x.w)) for j in range(int(x.y), int(x.y + x.h))}
        assert g.a == len(cells)


def test_entropy_of_uniform_letters():
    assert math.log2(16) == 4.0
