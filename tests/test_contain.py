"""Containment: patterns and secrets that are sent to the tasks, and those that are shuffled, against brute force; what of a text needs Unicode's compatibility forms."""

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import contain, session


@pytest.fixture(params=["sent", "shuffled"])
def way(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(contain, "BROADCAST", 0)
    return request.param


def made(seed=5):
    r = random.Random(seed)
    word = lambda a, b: "".join(r.choice("abé𝔸 ") for _ in range(r.randint(a, b)))
    texts = [(i % 40, r.choice(["x", "y", None]), r.choice([None, "", word(0, 5), word(20, 60)])) for i in range(120)]
    return texts, [(r.choice(["x", "y", None]), word(1, 9)) for _ in range(200)] + [("x", None)]


def test_holding_equals_brute_force(spark, way):
    texts, patterns = made()
    t, p = spark.createDataFrame(texts, "id int, s string, text string"), spark.createDataFrame(patterns, "s string, pattern string")
    got = sorted(map(str, map(tuple, contain.holding(t, p, within="s").collect())))
    assert got == sorted({str((i, s, w)) for i, s, x in texts for v, w in patterns if x and w and s == v and len(w) >= 3 and w in x}) and got
    got = sorted(map(str, map(tuple, contain.holding(t, p, least=4).collect())))
    assert got == sorted({str((i, w)) for i, _, x in texts for _, w in patterns if x and w and len(w) >= 4 and w in x}) and got


def test_shared_runs_equal_brute_force(spark, way):
    texts, patterns = made(6)
    texts = [(i, x) for i, (_, _, x) in enumerate(texts)]
    words = sorted({w + w for _, w in patterns if w})
    runs = lambda x: {x[i : i + 4] for i in range(len(x or "") - 3)}
    got = contain.shared_grams(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in [*words, None]], "secret string"), n=4).collect()
    want = {(i, w, len(runs(x) & runs(w)), len(runs(w))) for i, x in texts for w in words if runs(x) & runs(w)}
    assert {(g.id, g.secret, g.n_shared, g.n_grams) for g in got} == want and len(got) == len(want) > 100


def test_containment_moves_no_texts(spark):
    t = spark.createDataFrame([(1, "some text")], "id int, text string")
    plan = contain.holding(t, spark.createDataFrame([("me text",)], "pattern string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan


def test_texts_that_are_stable_stay_out_of_python(spark):
    unstable = re.compile("[" + "".join(chr(int(c, 16)) if sep != "-" else "-" + chr(int(c, 16)) for sep, c in re.findall(r"(-?)\\x\{([0-9a-f]+)\}", "".join(re.findall(r"(?:\\x\{[0-9a-f]+\}-\\x\{[0-9a-f]+\})(?!&&)", T.unstable())))) + "]")
    r = random.Random(3)
    letters = [chr(c) for c in range(0x20, sys.maxunicode) if not 0xD800 <= c < 0xE000]
    for x in letters:
        assert unstable.match(x) or unicodedata.normalize("NFKC", x) == x
    texts = ["".join(r.choice(letters[:0x3000] if i % 2 else letters) for _ in range(4)) for i in range(20_000)]
    assert all(unstable.search(x) or unicodedata.normalize("NFKC", x) == x for x in texts)
    some = ["ä", "ﬁ", "é", "가", "Ａ", "straße", "क़", None, "", "x" * 1000 + "²", *texts[:500]]
    nfkc = T.normalize_any()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, s string").select("s", F.col("s").rlike(T.unstable()).alias("u"), nfkc(F.col("s")).alias("n"), T.normalize(F.col("s")).alias("p")).collect()
    assert all(g.u == bool(unstable.search(g.s)) for g in got if g.s is not None) and got[0].u is False and [g.n for g in got[:6]] == ["ä", "fi", "é", "가", "a", "straße"]
    assert all(g.n == g.p for g in got if g.s is not None and not g.u)


def test_values_are_replaced_as_written(spark):
    rows = spark.createDataFrame([(1, "a", "Ann LEE ann lee a.b(c)"), (2, "b", "Ann Lee"), (3, None, "Ann Lee"), (4, "a", None), (5, "a", "an")], "id int, session string, text string")
    handles = spark.createDataFrame([("a", "ann lee", "<1>"), ("a", "a.b(c)", "<2>"), (None, "ann lee", "<3>"), ("a", "an", "<4>")], "session string, key string, handle string")
    got = {r.id: r.text for r in session.substitute_known(rows, "text", handles, ["id"]).collect()}
    assert got == {1: "<1> <1> <2>", 2: "Ann Lee", 3: "<3>", 4: None, 5: "an"}


def test_small_sessions_meet_their_values_only(spark, monkeypatch):
    """Sessions of few values look through their own texts against them, others by characters, with the same result."""
    rows = spark.createDataFrame([("a", 1, "Asha RAO and Ravi"), (None, 2, "ravi, asha rao"), ("b", 3, "Meera met Asha Rao"), ("c", 4, "asha rao"), ("a", 5, "")], "session string, id long, text string")
    handles = spark.createDataFrame([("a", "asha rao", "⟦P#1⟧"), ("a", "ravi", "⟦P#2⟧"), ("a", "ra", "⟦P#3⟧"), (None, "ravi", "⟦P#1⟧"), ("b", "meera", "⟦P#1⟧")], "session string, key string, handle string")
    want = {1: "⟦P#1⟧ and ⟦P#2⟧", 2: "⟦P#1⟧, asha rao", 3: "⟦P#1⟧ met Asha Rao", 4: "asha rao", 5: ""}
    got = lambda: {r.id: r.text for r in session.substitute_known(rows, "text", handles, ["id"]).collect()}
    searched, real = [], contain.holding
    monkeypatch.setattr(contain, "holding", lambda *a, **k: searched.append(1) or real(*a, **k))
    assert got() == want and not searched
    monkeypatch.setattr(session, "LOT", 1)
    assert got() == want and searched
