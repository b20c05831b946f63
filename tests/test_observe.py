"""Observations: worked examples of sanitizing, tables of labels, and the walk of a page."""

import pytest
from pyspark.sql import functions as F

from siftwork.operators import context, observe
from siftwork.plans.observation import EVIDENCE, FAILURES
from siftwork.sources import pages

RECT = "rect struct<x:double,y:double,w:double,h:double>"
ELEMENTS = f"session string, obs long, ord int, id string, tag string, type string, input_type string, role string, autocomplete string, maxlength int, label_raw string, placeholder_raw string, {RECT}, visible boolean, enabled boolean, unexplained boolean"
TEXTS = f"session string, obs long, ord int, id string, text string, {RECT}"
FRAMES = f"obs long, ord int, id int, {RECT}, origin string"


def element(obs, n, tag, rect, label="", **more):
    at = {"type": None, "autocomplete": None, "placeholder": None, "unexplained": False, **more}
    return ("s", obs, n, f"e{n}", tag, at["type"], at["type"], tag, at["autocomplete"], None, label, at["placeholder"], tuple(map(float, rect)), True, True, at["unexplained"])


@pytest.fixture(scope="module")
def made(spark):
    elements = [
        element(1, 0, "input", (0, 0, 100, 20), "Your e-mail", type="email", autocomplete="email", placeholder="me@zmail.in"),
        element(1, 1, "div", (0, 40, 100, 20), "asha.rao@zmail.in"),
        element(1, 2, "canvas", (0, 400, 300, 100), "chart"),
        element(1, 3, "div", (0, 400, 100, 50), "drawn", unexplained=True),
        element(1, 4, "input", (200, 0, 100, 20), "Password", type="password"),
        element(2, 0, "button", (0, 0, 80, 20), "Send to Asha.Rao@zmail.in"),
    ]
    texts = [
        ("s", 1, 0, "t0", "Write to asha.rao@zmail.in or 9876543210", (0.0, 100.0, 203.0, 20.0)),
        ("s", 1, 1, "t1", "painted words", (10.0, 420.0, 90.0, 20.0)),
        ("s", 1, 2, "t2", None, (0.0, 300.0, 90.0, 20.0)),
        ("s", 2, 0, "t0", "Thanks, asha.rao@zmail.in. Meet Ravi Das", (0.0, 100.0, 300.0, 20.0)),
        ("other", 3, 0, "t0", "asha.rao@zmail.in", (0.0, 100.0, 300.0, 20.0)),
    ]
    evidence = [("s", 2, 0, "ner", "ner", "PER", 0.9, (0.0, 100.0, 300.0, 20.0), "Ravi Das"), ("s", 2, 1, "ner", "ner", "LOC", 0.9, (0.0, 100.0, 300.0, 20.0), "City")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return observe.sanitize(frame(elements, ELEMENTS), frame(texts, TEXTS), frame([], FRAMES), frame(evidence, EVIDENCE), frame([], FAILURES), "STRICT"), frame(elements, ELEMENTS), frame(texts, TEXTS)


def test_values_become_handles_of_their_session(made):
    texts = {(r.session, r.obs, r.id): r.text for r in made[0].texts.collect()}
    handles = {(r.session, r.key): (r.kind, r.handle) for r in made[0].handles.collect()}
    kind, mail = handles["s", "asha.rao@zmail.in"]
    assert kind == "EMAIL" and mail.startswith("⟦EMAIL#") and handles["other", "asha.rao@zmail.in"] == ("EMAIL", "⟦EMAIL#1⟧")
    assert texts["s", 1, "t0"] == f"Write to {mail} or {handles['s', '9876543210'][1]}"
    assert texts["s", 2, "t0"] == f"Thanks, {mail}. Meet {handles['s', 'ravi das'][1]}"
    assert texts["other", 3, "t0"] == "⟦EMAIL#1⟧" and texts["s", 1, "t2"] == ""
    assert ("s", "city") not in handles  # a label's word is no value
    withheld = texts["s", 1, "t1"]  # below pixels that no one explains
    assert withheld == handles["s", "painted words"][1] and withheld.startswith("⟦PERSONAL#")
    assert len({h for (s, _), (_, h) in handles.items() if s == "s"}) == len([k for k in handles if k[0] == "s"])


def test_elements_keep_labels_and_get_classes(made):
    got = {(r.obs, r.id): r for r in made[0].elements.collect()}
    mail = next(r.handle for r in made[0].handles.collect() if r.session == "s" and r.kind == "EMAIL")
    assert (got[1, "e0"].label_raw, got[1, "e0"].placeholder_raw, got[1, "e0"].sensitivity_class) == ("Your e-mail", "[example email]", "EMAIL")
    assert got[1, "e1"].label_raw == mail and got[1, "e1"].sensitivity_class == "EMAIL"
    assert got[1, "e3"].label_raw == "[REDACTED]" and got[1, "e4"].sensitivity_class == "PASSWORD"
    assert got[2, "e0"].label_raw == f"Send to {mail}" and got[2, "e0"].available_actions == ["CLICK", "SCROLL", "PRESS_KEY"]
    actions = {r.reason.split(":")[0] for r in made[0].redactions.collect()}
    assert {"DROP", "VAULT_ONLY"} <= actions
    assert any("opaque <canvas>" in r.reason for r in made[0].redactions.collect())


def test_observation_is_built_and_scored(spark, made):
    done, elements, texts = made
    page = spark.createDataFrame([("s", 1, "Mail of asha.rao@zmail.in", "/u"), ("s", 2, None, None)], "session string, obs long, title string, url string")
    got = {r.obs: r for r in observe.build(done, page).collect()}
    assert got[1].title.startswith("Mail of ⟦EMAIL#") and len(got[1].elements) == 5 and not got[1].truncated and got[2].title == ""
    assert all(e.rect.x % 4 == 0 for e in got[1].elements) and any(h.startswith("⟦EMAIL#") for h in got[1].handles)
    score = {r.obs: r for r in observe.utility(elements, texts, done.elements, done.texts).collect()}
    assert (score[1].n, score[1].usable) == (5, 3) and 0 < score[1].literal < 1


def test_failed_sources_leave_their_regions(spark):
    status = spark.createDataFrame([(1, "ner", True, 10, 50), (1, "ocr", True, 60, 50), (2, "ner", False, 1, 50)], "obs long, source string, ok boolean, elapsed_ms int, timeout_ms int")
    coverage = spark.createDataFrame([(1, 0, "ocr", (0.0, 0.0, 8.0, 8.0)), (1, 1, "ner", (0.0, 0.0, 8.0, 8.0)), (2, 0, "ner", (0.0, 0.0, 8.0, 8.0))], f"obs long, ord int, source string, {RECT}")
    degraded, lost = observe.sources(status, coverage)
    assert sorted(map(tuple, degraded.collect())) == [(1, "ocr_timeout"), (2, "ner_error")]
    assert sorted((r.obs, r.reason) for r in lost.collect()) == [(1, "ocr: ocr_timeout"), (2, "ner: ner_error")]


def node(obs, n, text, x, y, w=100, h=20):
    return (obs, n, f"{obs}-{n}", text, float(x), float(y), float(w), float(h))


def test_tables_under_labels(spark):
    """Two tables, one below the other: a cell is taken once; half-empty rows, cells between columns and single values are not."""
    page = [node(1, 0, "Name", 0, 0), node(1, 1, "City", 120, 0), node(1, 2, "Asha Rao", 0, 40), node(1, 3, "Nagpur", 120, 43), node(1, 4, "Ravi Das", 0, 80), node(1, 5, "Pune", 120, 80), node(1, 6, "Only One", 0, 120), node(1, 7, "between", 70, 160, 100), node(1, 8, "MRN", 0, 200), node(1, 9, "Name", 120, 200), node(1, 10, "MR-1001", 0, 240), node(1, 11, "Third Name", 120, 240), node(1, 12, "MR-1002", 0, 280), node(1, 13, "Fourth Name", 120, 280)]
    lonely = [node(2, 0, "Name", 0, 0), node(2, 1, "City", 120, 0), node(2, 2, "Asha Rao", 0, 40), node(2, 3, "Nagpur", 120, 40)]
    df = spark.createDataFrame(page + lonely, "obs long, ord int, id string, text string, x double, y double, w double, h double")
    got = {(r.id, r.type) for r in context.table(df).collect()}
    first = {("1-2", "PERSON_NAME"), ("1-4", "PERSON_NAME"), ("1-3", "CITY"), ("1-5", "CITY")}
    assert first <= got and {("1-10", "MRN"), ("1-12", "MRN")} <= got
    ids = [i for i, _ in got]
    assert len(ids) == len(set(ids)) and not {"1-6", "1-7", "2-2", "2-3"} & set(ids)
    assert context.table(df.limit(0)).count() == 0


def test_walk_of_a_page(spark):
    html = """<html><head><title>x</title></head><body><nav><a href="/a">Home</a></nav><main><form><label for="m">Mail</label><input id="m" type="email" placeholder="p">
    <input type="hidden" value="1"><label>Agree <input type="checkbox" checked></label><button disabled>Go <b>now</b></button><button>Stop</button></form>
    <div hidden><a href="/h">gone</a></div><img alt="A cat" src="c.png"><div onclick="f()" tabindex="-1" aria-label="Menu"></div></main></body></html>"""
    d = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r for r in pages.walk(d).collect()}
    by = {(e.tag, e.name): e for e in got[1].elements}
    assert by["input", "Mail"].path == "main > form > input#m" and by["input", "Mail"].role == "textbox" and by["input", "Mail"].focusable
    assert by["input", "Agree"].checked and by["input", "Agree"].role == "checkbox" and by["a", "Home"].group == "nav"
    go, stop = by["button", "Go now"], by["button", "Stop"]
    assert go.disabled and not go.focusable and stop.path.endswith("button:nth-of-type(2)") and by["img", "A cat"].kind == "media"
    assert by["div", "Menu"].kind == "interactive" and not by["div", "Menu"].focusable and not any(e.name == "gone" for e in got[1].elements)
    assert [t.text for t in got[1].texts][:2] == ["Home", "Mail"] and got[2].elements == [] and got[3].texts == []
    every = {e.name: e.hidden for e in pages.walk(d, hidden=True).first().elements}
    assert every["gone"] and not every["Home"]
    many = pages.walk(d.limit(1).select("page_id", F.repeat(F.lit("<a href='/x'>y</a>"), 500).alias("html"))).first()
    assert many.truncated and len(many.elements) == 400 and len(many.texts) == 300


def test_utility_walks_pages_once(spark, sf_dir, monkeypatch):
    from siftwork.plans import observation

    monkeypatch.setattr(observation, "cut", lambda df, name, real=observation.cut: made.append(name) or real(df, name))
    made = []
    plan = observation.utility(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert made == ["walked"] and "html" not in plan


def test_redactions_write_no_texts_and_no_handles(spark, made, monkeypatch):
    _, elements, texts = made
    frame = lambda schema: spark.createDataFrame([], schema)
    monkeypatch.setattr(observe, "cut", lambda df, name, real=observe.cut: names.append(name) or real(df, name))
    names = []
    done = observe.sanitize(elements, texts, frame(FRAMES), frame(EVIDENCE), frame(FAILURES), "STRICT")
    assert done.redactions.count() and names == ["observed-hits", "observed-evidence", "observed-regions"]
    assert done.elements.count() == 6 and names[3:] == ["observed-handles"]


def test_nodes_meet_few_lines_of_labels(spark):
    """Nodes stay where they are where few lines are labels."""
    df = spark.createDataFrame([node(1, 0, "Name", 0, 0), node(1, 1, "City", 120, 0), node(1, 2, "Asha Rao", 0, 40)], "obs long, ord int, id string, text string, x double, y double, w double, h double")
    plan = context._cells(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
