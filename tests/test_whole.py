"""Queries and operators that do more than SQL twins tell, against brute force."""

import pytest
from pyspark.sql import functions as F

from siftwork.operators import gate, recognize, session
from siftwork.plans import probes, relational, release


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    """Writes small tables and gives their folder."""

    def run(**tables):
        at = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return run


def test_registry_scan_sees_fragments(spark):
    secrets = spark.createDataFrame([("Correct Horse", 1), ("batterystaple", 3), ("short", 1), ("elephantine", None)], "secret string, tier int")
    texts = ["correct horse", "a rect hors b", "RECT  HORS", "rect hor", "xbatteryst", "batterystaple", "short", "elephant", None]
    strings = spark.createDataFrame(list(enumerate(texts)), "payload_id int, value string")
    got = lambda *a, **k: {r.payload_id for r in gate.registry_scan(strings, *a, **k).collect()}
    assert got(secrets) == {0, 1, 2, 3, 5, 7}
    assert got(secrets.drop("tier")) == {0, 1, 2, 3, 4, 5, 7}
    assert got(secrets, fragments=False) == {0, 5}


def test_shared_grams_of_eight(spark, write):
    docs = [(1, "s", "one fragment of it"), (2, "s", "nothing"), (3, "s", None), (4, "s", "the whole fragment of")]
    items = [(1, "xx fragment yy"), (2, "xx fragment yy"), (3, "the whole fragment of")]
    sf = write(documents=(docs, "doc_id long, source string, text string"), benchmark=(items, "item_id long, text string"))
    runs = lambda t: {t[i : i + 8] for i in range(len(t or "") - 7)}
    want = {(d, i, len(runs(t) & runs(x))) for d, _, t in docs for i, x in items if runs(t) & runs(x)}
    assert sorted(map(tuple, relational.ngram_matches_8(spark, sf).collect())) == sorted(want)
    assert sorted(r.doc_id for r in relational.ngram_overlap_8(spark, sf).collect()) == [1, 4]
    secret = {r.payload_id for r in release.gate_registry_whole(spark, write(documents=([(1, "s", "a tremendo b"), (2, "s", "tremend")], "doc_id long, source string, text string"), benchmark=([(1, "tremendously")], "item_id long, text string"))).collect()}
    assert secret == {1}


def test_all_recognizers(spark, sf_dir, write):
    texts = ["user@zmail.in", "+91 9876543210", "ABCDE1234F", "2345 6789 0124", "rahul.123@okhdfcbank", "sk_live_abcdEFGH12345678", "5555555555554444", "nothing here", None]
    sf = write(documents=([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string"), benchmark=([(1, "unmentioned")], "item_id long, text string"))
    assert {r.payload_id for r in release.gate_sweep_whole(spark, sf).collect()} == set(range(7))
    verdict = {r.payload_id: r.code for r in release.gate_verdict_whole(spark, sf).collect()}
    assert verdict == {i: "TYPE_BRAND" if i < 7 else None for i in range(9)}
    rows = probes.probe(spark, sf_dir)
    each = [(r.doc_id, r.start, r.type, r.tier) for n in recognize.RECOGNIZERS for r in recognize.detect(rows, "doc_id", "text", (n,)).collect()]
    got = {r.doc_id: (r.n, r.starts, r.identifiers) for r in probes.rec_text_whole(spark, sf_dir).collect()}
    assert got == {d: (len(x := [e for e in each if e[0] == d]), sum(e[1] for e in x), sum(e[3] < 3 for e in x)) for d in {e[0] for e in each}}
    kinds = {(r.doc_id, r.type): (r.n, r.first_start) for r in probes.rec_detect_whole(spark, sf_dir).collect()}
    assert kinds == {k: (len(x := [e[1] for e in each if (e[0], e[2]) == k]), min(x)) for k in {(e[0], e[2]) for e in each}}
    assert any(t == "SECRET" for _, t in kinds)


def test_compatibility_forms(spark, write):
    wide = "４１１１１１１１１１１１１１１１"
    turns = [("ＡＢ c\u00a0 d", "ab c d"), ("é É", "é é"), (None, None), ("Plain  x", "plain x"), (wide, "4" + "1" * 15)]
    sf = write(conversations=([(i, 0, "user", t) for i, (t, _) in enumerate(turns)], "conv_id long, turn int, role string, text string"))
    assert {r.conv_id: r.text for r in relational.normalize_whole(spark, sf).collect()} == {i: t for i, (_, t) in enumerate(turns)}
    secrets = spark.createDataFrame([("4" + "1" * 15,), ("ｓｅｃｒｅｔｗｏｒｄ",)], "secret string")
    strings = spark.createDataFrame([(1, f"x {wide} y"), (2, "a secretword b"), (3, "none")], "payload_id int, value string")
    assert {r.payload_id for r in gate.registry_scan(strings, secrets, fragments=False).collect()} == {1, 2}
    assert {(r.payload_id, r.secret) for r in gate.literal_scan(strings, secrets).collect()} == {(1, "4" + "1" * 15), (2, "ｓｅｃｒｅｔｗｏｒｄ")}
    leaks = gate.leakage(spark.createDataFrame([("r", wide)], "run string, body string"), spark.createDataFrame([("r", "4" + "1" * 15, 1)], "run string, value string, tier int"))
    assert leaks.first().leaked == 1
    values = spark.createDataFrame([("s", 1, wide, "CARD", 2), ("s", 2, "4" + "1" * 15, "CARD", 2)], "session string, ord long, value string, type string, tier int")
    assert session.numbered(values).count() == 1


def test_substitute_takes_what_the_session_knows(spark, write):
    card = "4532015112830366"
    docs = [(1, "a", f"pay {card} now"), (2, "a", f"Order ID: {card}"), (3, "b", f"Order ID: {card}"), (4, "a", "Mail USER@zmail.in and user@zmail.in"), (5, None, f"pay {card}"), (6, None, f"Order ID: {card}"), (7, "a", None)]
    got = {r.doc_id: r.text for r in relational.substitute(spark, write(documents=(docs, "doc_id long, source string, text string"))).collect()}
    assert len(got) == 7 and got[3] == docs[2][2] and got[7] == ""
    assert got[2] == "Order ID: " + got[1][4:-4] and "⟦CARD" in got[2]
    assert got[6] == "Order ID: " + got[5][4:] and "⟦CARD" in got[6]
    assert got[4].count("⟦EMAIL#") == 2 and "zmail" not in got[4]


def test_scores_take_all_documents(spark, write):
    docs = [(1, "src1", "a 5555-5555-5555-4444 b"), (2, "elsewhere", "tremendously 4532015112830366"), (3, None, "x tremendously")]
    sf = write(documents=(docs, "doc_id long, source string, text string"), benchmark=([(1, "tremendously")], "item_id long, text string"))
    assert {r.doc_id for r in release.span_f1(spark, sf).collect()} == {1, 2}
    assert {r.run: (r.n, r.leaked) for r in release.score_privacy(spark, sf).collect()} == {"src1": (1, 0), "elsewhere": (1, 1), None: (1, 1)}
