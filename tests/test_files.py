"""Files, pictures, a classifier's plumbing and sinks on worked examples."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import gate, ner, pictures, sessions
from siftwork.sources import files

RECT = "rect struct<x:double,y:double,w:double,h:double>"
POLICY = {"policy": {"name": "STRICT", "unexplained_prior": 0.8, "screenshot": {"enabled": False}, "thresholds": {"tokenize": 0.35, "mask": 0.5, "drop": 0.8}, "tiers": {f"T{k}": "TOKENIZE" for k in range(1, 6)}, "fail_mode": "CLOSED", "max_elements": 400}, "fusion": {"source_weights": {"regex": 1, "ner": 0.9}, "min_coverage": 0.98}}


def test_policies(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(POLICY, indent=2))
    bad = json.loads(json.dumps(POLICY))
    bad["policy"]["thresholds"]["mask"], bad["fusion"]["source_weights"]["ner"], bad["policy"]["name"] = 0.9, 2, "LAX"
    del bad["policy"]["tiers"]["T3"]
    (tmp_path / "b.json").write_text(json.dumps(bad))
    got = {r.file: r.faults for r in files.policies(spark, str(tmp_path)).collect()}
    assert got == {"a.json": [], "b.json": ["name", "thresholds", "tiers", "source_weights"]}
    bad["policy"]["thresholds"]["mask"] = "high"
    (tmp_path / "b.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        files.policies(spark, str(tmp_path)).collect()


def test_tasks(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("id: T2\ntitle: 'Two words'\nsteps:\n  - click: x\nurl: http://h/x\n")
    (tmp_path / "a.yml").write_text("# first\nid: T1\nsuccess:\n  kind: outcome\n")
    (tmp_path / "c.txt").write_text("id: T3\n")
    got = files.tasks(spark, str(tmp_path)).collect()
    assert [(r.id, r.fields) for r in got] == [("T1", {"id": "T1"}), ("T2", {"id": "T2", "title": "Two words", "url": "http://h/x"})]
    assert [r.id for r in files.tasks(spark, str(tmp_path), ["T2"]).collect()] == ["T2"]


def test_truth_of_instrumented_pages(spark):
    html = """<div data-truth-pii="EMAIL" data-truth-tier="2" data-truth-value-id="v_1">a@<b>b.co</b></div><p data-truth-pii="NONE">x</p><i data-truth-pii="PAN" data-truth-tier="2" data-truth-decoy="true"> P1 </i>
    <i data-truth-pii="PAN"></i><canvas data-truth-regions='[{"x":1,"y":2,"w":3,"h":4,"pii":"CARD","value_id":"v_2"}]'></canvas><canvas data-truth-regions="broken"></canvas>"""
    got = files.truth(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(p.type, p.tier, p.value_id, p.decoy, p.value) for p in got[0].pii] == [("EMAIL", 2, "v_1", False, "a@b.co"), ("PAN", 2, None, True, "P1")]
    assert [tuple(r) for r in got[0].regions] == [("CARD", "v_2", 1.0, 2.0, 3.0, 4.0)] and got[1].pii == [] == got[1].regions


def test_draws(spark):
    def mulberry(seed, n):
        m = 0xFFFFFFFF
        t = (seed + (n + 1) * 0x9E3779B9) & m
        r = (t ^ t >> 15) * (1 | t) & m
        r ^= (r + ((r ^ r >> 7) * (61 | r) & m)) & m
        return (r ^ r >> 14) / 2**32

    got = spark.range(1000).select("id", *[files.draw(F.col("id"), n).alias(f"u{n}") for n in range(3)], files.chosen(F.col("id"), 1, "abc").alias("c")).collect()
    assert all([r.u0, r.u1, r.u2] == [mulberry(r.id, n) for n in range(3)] and r.c == "abc"[int(r.u1 * 3)] for r in got)


def test_pictures(spark):
    r = np.random.default_rng(3)
    raw = {i: r.integers(0, 255, (h, w, 4), dtype=np.uint8) for i, (w, h) in enumerate([(10, 7), (1300, 5), (33, 1000), (1, 1)])}
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in raw.items()] + [(9, 2, 2, bytearray(b"short")), (10, None, 1, None)]
    df = spark.createDataFrame(rows, "id long, w int, h int, rgba binary")
    boxes = [(0, (2.6, 1.2, 3.1, 2.0)), (0, (-3.0, -3.0, 2.5, 2.5)), (0, (8.0, 5.0, 50.0, 50.0)), (1, (5.0, 0.0, 0.0, 9.0)), (9, (0.0, 0.0, 1.0, 1.0))]
    got = {x.id: x for x in pictures.redact(df, spark.createDataFrame(boxes, f"id long, {RECT}")).collect()}
    want = raw[0].copy()
    for a, b, c, d in ((1, 3, 2, 6), (0, 3, 0, 3), (5, 7, 8, 10)):
        want[a:b, c:d] = (0, 0, 0, 255)
    assert bytes(got[0].rgba) == want.tobytes() and bytes(got[1].rgba) == raw[1].tobytes() and got[9].rgba is None and got[10].w is None
    small = {x.id: x for x in pictures.downscale(df).collect()}
    assert (small[1].w, small[1].h, small[2].w, small[2].h, small[0].w) == (640, 2, 21, 640, 10)
    assert abs(np.frombuffer(bytes(small[1].rgba), np.uint8).mean() - raw[1].mean()) < 2 and pictures.downscale(df.limit(0)).count() == 0


def test_tags_become_spans(spark):
    text = "Ravi  Das lives in (New) Delhi. ravi das"
    tokens = [("B-PER", 0.8, "Ravi"), ("I-PER", 0.6, "Das"), ("B-LOC", 0.9, "New"), ("B-MISC", 0.9, "absent"), ("B-LOC", 0.5, "Del"), ("B-LOC", 0.7, "##hi"), ("I-PER", 0.4, "ravi")]
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(tokens)], "id long, ord int, entity string, score double, word string")
    got = sorted((r.start, r.end, r.type, round(r.confidence, 3)) for r in ner.bio_decode(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), t, "id").collect())
    assert got == [(0, 9, "PER", 0.7), (20, 23, "LOC", 0.9), (25, 30, "LOC", 0.6), (32, 36, "PER", 0.4)]


def test_tags_of_a_long_text_become_spans(spark):
    """Groups far behind the one before, and words that begin with the mark of others."""
    text = "##A B" + " x" * 5000 + " Ada L" + " y" * 3000 + " ## Rome ada l"
    tokens = [("B-PER", 0.5, "##A"), ("I-PER", 0.5, "B"), ("B-PER", 0.5, "Ad"), ("I-PER", 0.5, " ##a"), ("I-PER", 0.5, "L"), ("B-LOC", 0.5, "##"), ("I-LOC", 0.5, "Rome"), ("B-PER", 0.5, "ADA")]
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(tokens)], "id long, ord int, entity string, score double, word string")
    got = sorted((r.start, r.end, text[r.start : r.end]) for r in ner.bio_decode(spark.createDataFrame([(1, text)], "id long, text string"), t, "id", " ##").collect())
    assert [x[2] for x in got] == ["##A B", "Ada L", "## Rome", "ada"] and [x[0] for x in got] == [0, text.index("Ada"), text.index("## Rome"), text.rindex("ada")]


def test_windows_go_through_a_model(spark):
    text = " ".join(f"w{i}" if i % 10 else "kamala" for i in range(1200))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "toto kamala")], "doc_id long, text string")
    from siftwork.plans.models import gazetteer

    got = sorted((r.doc_id, r.start, r.end, r.type) for r in ner.chunked(df, "doc_id", "text", gazetteer, 0.5).collect())
    at = [i for i in range(len(text)) if text.startswith("kamala", i)]
    assert got == [(1, i, i + 6, "PER") for i in at] + [(4, 5, 11, "PER")]
    assert len(ner.chunked(df, "doc_id", "text", gazetteer, 0.3).where("doc_id = 4").collect()) == 2


def test_evidence_leaves_controls_and_common_words_out(spark):
    nodes = spark.createDataFrame([(1, 0, "t0", "Meet Ravi Das", "e0"), (1, 1, "t1", "Back", "e1"), (1, 2, "t2", "Shipping Address", None)], "obs long, ord int, id string, text string, owner string")
    elements = spark.createDataFrame([(1, "e0", "div", "generic"), (1, "e1", "button", "button")], "obs long, id string, tag string, role string")
    spans = spark.createDataFrame([(1, 5, 13, "PER", 0.9), (1, 14, 18, "PER", 0.9), (1, 19, 35, "LOC", 0.9), (1, 5, 9, "ORG", 0.9)], "obs long, start long, end long, type string, confidence double")
    assert [(r.id, r.pii_type, r.surface) for r in ner.evidence(spans.where("type <> 'ORG'"), nodes, elements).collect()] == [("t0", "NAME", "Ravi Das")]


def test_refused_payloads_do_not_count(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), i, i * 100 + r.randint(0, 90), r.random() < 0.7) for i in range(200)]
    got = {x.i: x.accepted for x in sessions.rate_limit(spark.createDataFrame(rows, "s string, i long, ms long, ok boolean"), "s", "ms", "i", 1000, 3, counts="ok").collect()}
    kept, want = {}, {}
    for s, i, ms, ok in sorted(rows, key=lambda x: (x[2], x[1])):
        want[i] = sum(ms - t <= 1000 for t in kept.get(s, [])) < 3
        if want[i] and ok:
            kept.setdefault(s, []).append(ms)
    assert got == want


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        files.append(rows, f"{tmp_path}/audit")
    files.report(rows, f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 4 and spark.read.json(f"{tmp_path}/report").count() == 2
    assert list(json.loads(files.exported_schema(rows))["definitions"]["rows"]["properties"])[0] == "id"
    out = f"{tmp_path}/sent"

    def post(batch):
        with open(out, "a") as f:
            f.write("".join(f"{json.dumps(x)}\n" for x in batch))

    files.send(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/audit"), post, f"{tmp_path}/state").awaitTermination(60)
    with open(out) as f:
        assert sorted(json.loads(x)["id"] for x in f) == [1, 1, 2, 2]


def test_strings_of_json(spark):
    df = spark.createDataFrame([(1, '{"a":["x",{"b":"y"}],"c":2}'), (2, "no json"), (3, None), (4, '"z"')], "id long, j string")
    assert [(r.id, r.path, r.value) for r in gate.json_strings(df, "id", "j").orderBy("id", "nth").collect()] == [(1, "a[0]", "x"), (1, "a[1].b", "y"), (4, "", "z")]
