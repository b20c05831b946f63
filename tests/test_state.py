"""Keyed state across runs, the audit log under retries, as-of joins and hit tests against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwork.operators import asof as A, chaos, fusion, hits
from siftwork.sources import auditlog
from siftwork.streaming import stores

VALUES = "session string, ord long, key string, type string, tier int, reset boolean"


def feed(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def test_counters_go_on_and_start_anew(spark, tmp_path):
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    beside = stores.ready(spark)
    run = lambda imported=None, m=mark: stores.run_to_end(stores.counters(beside.readStream.schema(VALUES).parquet(source), imported), out, m)
    state = lambda m=mark: {(r.session, r.key): r["index"] for r in stores.export(spark, m).collect()}
    feed(spark, source, [("s", 2, "b", "T", 2, False), ("s", 1, "a", "T", 2, False), ("s", 3, "a", "U", 1, None), ("t", 1, "b", "T", 2, False)], VALUES)
    run()
    assert state() == {("s", "a"): 1, ("s", "b"): 2, ("t", "b"): 1}
    feed(spark, source, [("s", 4, "c", "T", 2, False), ("s", 5, "b", "T", 2, False)], VALUES)
    run()  # goes on where the run before it stopped
    assert state() == {("s", "a"): 1, ("s", "b"): 2, ("s", "c"): 3, ("t", "b"): 1}
    feed(spark, source, [("s", 6, None, None, 0, True), ("s", 7, "z", "T", 2, False), ("t", 8, "q", "T", 2, False)], VALUES)
    run()
    assert state() == {("s", "z"): 1, ("t", "b"): 1, ("t", "q"): 2}
    exported = stores.export(spark, mark)
    assert {r.session: r.n for r in stores.distinct_values(exported).collect()} == {"s": 1, "t": 2}
    source2, mark2 = str(tmp_path / "in2"), str(tmp_path / "mark2")
    feed(spark, source2, [("t", 1, "new", "T", 2, False), ("t", 2, "q", "T", 2, False), ("u", 1, "x", "T", 2, False)], VALUES)
    stores.run_to_end(stores.counters(beside.readStream.schema(VALUES).parquet(source2), exported), str(tmp_path / "out2"), mark2)
    assert state(mark2) == {("s", "z"): 1, ("t", "b"): 1, ("t", "q"): 2, ("t", "new"): 3, ("u", "x"): 1}
    emitted = {(r.session, r.key): r["index"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert emitted == {("t", "new"): 3, ("u", "x"): 1}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stores.PROVIDER


def test_store_equals_a_dictionary(spark, tmp_path):
    r = random.Random(3)
    ops = [(r.choice("ab"), i, r.choice(["put", "put", "get", "get", "delete", "clear" if i % 9 == 0 else "get", "odd"]), r.choice("xyz"), str(i)) for i in range(300)]
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    held, want = {}, []
    for at in range(0, 300, 100):  # three batches of one stream
        feed(spark, source, ops[at : at + 100], "namespace string, ord long, op string, key string, value string")
        stores.run_to_end(stores.store(stores.ready(spark).readStream.schema("namespace string, ord long, op string, key string, value string").parquet(source)), out, mark)
    for n, i, op, k, v in ops:
        mine = held.setdefault(n, {})
        if op == "put":
            mine[k] = v
        elif op == "delete":
            mine.pop(k, None)
        elif op == "clear":
            mine.clear()
        elif op == "get":
            want.append((n, i, k, mine.get(k), k in mine))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(want)
    assert {(r.namespace, r.key): r.value for r in stores.contents(spark, mark).collect()} == {(n, k): v for n, m in held.items() for k, v in m.items()}


def test_audit_log_holds_each_batch_once(spark, tmp_path):
    auditlog.register(spark)
    path, schema = str(tmp_path / "log"), "id long, said string"
    rows = spark.range(100).select("id", F.lit("é").alias("said")).repartition(4)
    read = lambda: sorted(r.id for r in spark.read.format("audit").schema(schema).load(path).collect())
    for _ in range(3):
        rows.write.format("audit").option("batchId", "7").mode("append").save(path)
    assert read() == list(range(100))
    rows.write.format("audit").mode("append").save(path)  # a batch of its own
    assert read() == sorted([*range(100)] * 2)

    def fails(i):
        if i == 50:
            raise ValueError("no")
        return i

    broken = rows.select(F.udf(fails, "long")("id").alias("id"), "said")
    with pytest.raises(Exception):
        broken.write.format("audit").option("batchId", "8").mode("append").save(path)
    assert read() == sorted([*range(100)] * 2)
    rows.limit(0).write.format("audit").option("batchId", "9").mode("append").save(path)
    with pytest.raises(Exception, match="overwritten"):
        rows.write.format("audit").mode("overwrite").save(path)
    with pytest.raises(Exception, match="which columns"):
        spark.read.format("audit").load(path)


def test_a_stream_that_is_killed_between_commit_and_checkpoint_writes_nothing_twice(spark, tmp_path):
    auditlog.register(spark)
    source, path, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    start = lambda: spark.readStream.schema("id long").parquet(source).writeStream.format("audit").option("writer", "w").option("checkpointLocation", mark).trigger(availableNow=True).start(path).awaitTermination()
    read = lambda: sorted(r.id for r in spark.read.format("audit").schema("id long").load(path).collect())
    feed(spark, source, [(1,), (2,)], "id long")
    start()
    (tmp_path / "mark" / "commits" / "0").unlink()  # as if it had died before it noted the batch
    for crc in (tmp_path / "mark" / "commits").glob(".0*"):
        crc.unlink()
    start()
    assert read() == [1, 2]
    feed(spark, source, [(3,)], "id long")
    start()
    assert read() == [1, 2, 3]
    commits = auditlog._Log(StructType(), {"path": path}).commits()
    assert [c["rows"] for c in commits] == [2, 1]
    assert json.dumps(commits)


@pytest.mark.parametrize("blocks", [1, 4, 25])
def test_asof_equals_brute_force_with_a_hot_key(spark, blocks):
    r = random.Random(blocks)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), r.choice([None, *range(300)])) for i in range(400)]
    left += left[:5]
    right = [(key(), r.choice([None, *range(0, 300, 7)]), r.choice([None, r.randint(0, 9)]), "x") for _ in range(60)]
    a = spark.createDataFrame(left, "i int, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, v int, i string").repartition(2)
    got = sorted(map(repr, map(tuple, A.asof(a, b, "k", "t", ["v"], blocks).collect())))

    def state(k, t):
        mine = [(x[1], x[2] is not None, x[2] or 0, x[2]) for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        return (max(mine)[0], max(mine)[3]) if mine else (None, None)

    assert got == sorted(repr((i, k, t, *state(k, t))) for i, k, t in left)
    assert A.asof(a.limit(0), b, "k", "t", ["v"]).count() == 0 and A.asof(a, b.limit(0), "k", "t", ["v"]).where("v IS NOT NULL").count() == 0


def test_resolve_refuses_stale_ids(spark):
    o = spark.createDataFrame([("s", 1, 10), ("s", 2, 20)], "session string, observation long, at long")
    e = spark.createDataFrame([(1, "e0"), (1, "e1"), (2, "e0"), (2, "e0")], "observation long, id string")
    asks = [("s", 5, 1, "e0"), ("s", 10, 1, "e0"), ("s", 15, 1, "e9"), ("s", 25, 1, "e1"), ("s", 25, 2, "e0"), ("s", 25, None, "e0"), ("t", 25, 1, "e0"), ("s", 25, 2, None)]
    got = {tuple(r)[:4]: (r.current, r.status) for r in A.resolve(spark.createDataFrame(asks, "session string, at long, observation long, id string"), o, e).collect()}
    assert [got[x] for x in asks] == [(None, "none"), (1, "ok"), (1, "unknown"), (2, "stale"), (2, "ok"), (2, "ok"), (None, "none"), (2, "unknown")]
    assert [tuple(x) for x in A.current(o).orderBy("since").collect()] == [("s", 1, 10, 20), ("s", 2, 20, None)]


def test_occluded_equals_brute_force(spark):
    r = random.Random(6)
    rows = []
    for obs in range(6):
        for i in range(40):
            depth_end = i + r.choice([0, 0, 0, 1, 3])
            rows.append((obs, i, i, min(39, depth_end), (float(r.randint(-80, 300)), float(r.randint(-80, 300)), float(r.choice([0, 3, 20, 90, 400])), float(r.choice([0, 5, 30, 200])))))
    df = spark.createDataFrame(rows, "obs int, id int, ord int, end int, rect struct<x:double,y:double,w:double,h:double>")
    got = {(x.obs, x.id): x.occluded for x in hits.occluded(df).collect()}
    for obs, i, o, end, (x, y, w, h) in rows:
        points = [(x + w / 2, y + h / 2), (x + 2, y + 2), (x + w - 2, y + 2), (x + 2, y + h - 2), (x + w - 2, y + h - 2)]
        seen = False
        for px, py in points:
            over = [e for e in rows if e[0] == obs and e[4][2] > 0 and e[4][3] > 0 and e[4][0] <= px < e[4][0] + e[4][2] and e[4][1] <= py < e[4][1] + e[4][3]]
            if over:
                top = max(over, key=lambda e: e[2])
                seen |= top[2] <= o <= top[3] or o <= top[2] <= end
        assert got[obs, i] == (w == 0 or h == 0 or not seen)
    port = df.select("rect", hits.in_viewport(F.col("rect"), F.lit(200), F.lit(200)).alias("v")).collect()
    assert all(p.v == (p.rect.x + p.rect.w >= -50 and p.rect.y + p.rect.h >= -50 and p.rect.x <= 250 and p.rect.y <= 250) for p in port)


def test_chaos_settings_and_a_page_worked_out(spark):
    s = chaos.settings(spark).orderBy("setting").collect()
    assert len(s) == 22 and s[0].label == "healthy" and s[7].label == "ner+ocr+vision throw" and s[22 - 1].label == "ner+ocr+vision silent" and s[15].state == 9
    rect = lambda y: (0.0, float(y), 80.0, 16.0)
    shape = "struct<x:double,y:double,w:double,h:double>"
    evidence = spark.createDataFrame([(1, 1, "ner", "ner", "PERSON_NAME", 0.9, rect(0)), (1, 2, "dom", "regex", "PASSWORD", 0.2, rect(200))], f"obs long, ord long, source string, type string, pii_type string, confidence double, rect {shape}")
    coverage = spark.createDataFrame([(1, 1, "ner", rect(0), "ner_unavailable"), (1, 2, "ner", rect(400), "ner_unavailable")], f"obs long, ord long, source string, rect {shape}, reason string")
    truth = spark.createDataFrame([(1, "name", 3, rect(0), True), (1, "word", 1, rect(200), True), (1, "shot", 1, rect(800), False)], f"obs long, vid string, tier int, rect {shape}, readable boolean")
    got = {r.label: r for r in chaos.run(spark.createDataFrame([(1,), (2,)], "obs long"), evidence, coverage, truth, "STRICT").where("obs = 1").collect()}
    assert (got["healthy"].redactions, got["healthy"].leaked, got["healthy"].missed, got["healthy"].tier1_exposed) == (2, 0, 1, 0)
    assert (got["ner throw"].redactions, got["ner throw"].leaked, got["ner throw"].degraded) == (3, 0, "ner")
    assert (got["ner silent"].redactions, got["ner silent"].leaked, got["ner silent"].degraded, got["ner silent"].leaks_more, got["ner silent"].redacts_less) == (1, 1, "", True, True)
    assert got["ocr+vision timeout"].redactions == 2 and len(got) == 22


def test_chaos_states_are_told_by_one_row_a_region(spark):
    """Against fusion of each state's own evidence; a page of regions travels once for all states and profiles."""
    r = random.Random(3)
    shape = "struct<x:double,y:double,w:double,h:double>"
    rect = lambda: (float(r.randrange(0, 160, 10)), float(r.randrange(0, 160, 10)), float(r.choice([0, 12, 40])), 20.0)
    kind = lambda: r.choice([("dom", "regex", "EMAIL"), ("ner", "ner", "PERSON_NAME"), ("ocr", "ocr", "CREDIT_CARD"), ("vision", "vision", "PERSONAL"), ("ner", "other", "PASSWORD")])
    found = [(o, i, *kind(), r.choice([0.1, 0.4, 0.9]), r.choice([rect(), rect(), None])) for o in range(6) for i in range(r.randrange(12))]
    lost = [(o, i, r.choice(["ner", "ocr", "vision", "dom"]), rect(), "gone") for o in range(6) for i in range(4)]
    evidence = spark.createDataFrame(found, f"obs long, ord long, source string, type string, pii_type string, confidence double, rect {shape}").cache()
    coverage = spark.createDataFrame(lost, f"obs long, ord long, source string, rect {shape}, reason string").cache()
    bit = F.coalesce(*[F.when(F.col("source") == s, 1 << k) for k, s in enumerate(chaos.SOURCES)], F.lit(0))
    states = spark.createDataFrame([(s,) for s in chaos.STATES], "state int")
    both = F.struct("obs", "state").alias("obs")
    alive = evidence.join(states, F.col("state").bitwiseAND(bit) == 0).select(both, "ord", "type", "pii_type", "confidence", "rect")
    seen = coverage.join(states, (F.col("state") < 8) & (F.col("state").bitwiseAND(bit) > 0)).select(both, "ord", "rect", "reason")
    got = chaos.regions(evidence, coverage, ("STRICT", "BALANCED")).collect()
    assert len({(x.obs, x.rect) for x in got}) == len(got)
    for k, profile in enumerate(("STRICT", "BALANCED")):
        want = {(x.obs.obs, x.obs.state, x.rect) for x in fusion.fuse(alive, seen, profile).where("action <> 'PASS'").collect()}
        assert want and {(x.obs, s, x.rect) for x in got for i, s in enumerate(chaos.STATES) if x.hidden[k] >> i & 1} == want
