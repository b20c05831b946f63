"""Queries of what leaves and what is asked for: the whole gate, audits, canaries, scores of runs, a planner's actions; and their SQL twins.

Payloads are the driver's events, each with a body that its number decides; wires are documents, one run for each source; actions aim at the elements of scene.py.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import actions, context, gate, geometry as G, metrics
from siftwork.operators.shape import array, closed, integer, text
from siftwork.plans.probes import q
from siftwork.plans.relational import R, _BOTH, _MEET, _evidence, _pick, _KINDS, read, rects
from siftwork.plans.release import _SECRETS, registry
from siftwork.plans.scene import EL, elements, pick

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- the gate
SECRET, TOKEN = "orchid garden 77", "Zq8Xw2Lm5Rt9+Vb3Nc7Kj4Hd6Ye1"
SAID = {13: "plain words", 17: "an orchid gard of them", 19: "write to user@zmail.in", 23: TOKEN, 29: "x" * 700}
SCHEMAS = {"/v1/step": closed(step=integer(), session_id=text(), texts=array(text()), handles=array(closed(handle=text())))}
ALLOWED, LIMIT, WINDOW, MOST = "https://gate.example.org", 600, 3_600_000, 2


def payloads(spark, sf_dir):
    """Events as payloads: a field too many, a fragment of a secret, an address, a token, a malformed handle, a long body, another origin."""
    e = F.col("event_id")
    said = F.coalesce(*[F.when(e % n == 0, t) for n, t in SAID.items() if n != 13], F.lit("plain words"))
    handle = F.when(e % 31 == 0, "EMAIL#1").otherwise("⟦EMAIL#1⟧")
    extra = F.when(e % 13 == 0, ',"debug":1').otherwise("")
    body = F.concat(F.lit('{"step":'), e.cast("string"), F.lit(f',"session_id":"{TOKEN}","texts":["'), said, F.lit('"],"handles":[{"handle":"'), handle, F.lit('"}]'), extra, F.lit("}"))
    path = F.when(e % 37 == 0, "/v1/health").otherwise("/v1/step")
    to = F.when(e % 11 == 0, "https://elsewhere.example.org/x").otherwise(f"{ALLOWED}/v1")
    return read(spark, sf_dir, "events").select(e.alias("payload_id"), F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), path.alias("path"), F.when((e % 37 != 0) | (e % 2 == 0), body).alias("body"), to.alias("destination"))


_EARLY = "CASE WHEN (i % 37 = 0 AND i % 2 = 0) OR (i % 37 <> 0 AND i % 13 = 0) THEN 'SCHEMA_CONFORMANCE' WHEN i % 37 = 0 THEN NULL WHEN i % 17 = 0 THEN 'REGISTRY_SCAN' WHEN i % 31 = 0 OR i % 19 = 0 THEN 'TYPE_BRAND' WHEN i % 23 = 0 THEN 'ENTROPY_HEURISTIC' WHEN i % 29 = 0 THEN 'SIZE_BUDGET' END"
_LIMITED = "rate AS (SELECT i, s, n, early, pinned, ok FROM (WITH RECURSIVE st(s, n, i, early, pinned, ok, kept) AS (SELECT DISTINCT s, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, NULL::BOOLEAN, []::BIGINT[] FROM o UNION ALL SELECT o.s, o.n, o.i, o.early, o.pinned, len(list_filter(st.kept, lambda t: o.ms - t <= {window})) < {most}, CASE WHEN o.early IS NULL AND o.pinned AND len(list_filter(st.kept, lambda t: o.ms - t <= {window})) < {most} THEN list_append(list_filter(st.kept, lambda t: o.ms - t <= {window}), o.ms) ELSE list_filter(st.kept, lambda t: o.ms - t <= {window}) END FROM st JOIN o ON o.s = st.s AND o.n = st.n + 1) FROM st) WHERE n > 0)"


@query(f"WITH e AS (SELECT event_id AS i, user_id AS s, epoch_ms(ts) AS ms, {_EARLY.replace('i %', 'event_id %')} AS early, event_id % 11 <> 0 AS pinned FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ms, i) AS n FROM e WHERE early IS NULL), {_LIMITED.format(window=WINDOW, most=MOST)} SELECT e.i AS payload_id, coalesce(e.early, CASE WHEN NOT rate.ok THEN 'RATE_LIMIT' END, CASE WHEN NOT e.pinned THEN 'DESTINATION_PIN' END) AS code FROM e LEFT JOIN rate ON e.i = rate.i")
def gate_all(spark, sf_dir):
    """All seven checks in order."""
    secrets = spark.createDataFrame([(SECRET, 1), ("tracking", 3), ("short", 1)], "secret string, tier int")
    return gate.gate(payloads(spark, sf_dir), secrets, SCHEMAS, ALLOWED, LIMIT, WINDOW, MOST)


@query("SELECT event_id AS payload_id, 'SCHEMA_CONFORMANCE' AS code FROM events WHERE (event_id % 37 = 0 AND event_id % 2 = 0) OR (event_id % 37 <> 0 AND event_id % 13 = 0)")
def gate_schema(spark, sf_dir):
    return gate.schema_check(payloads(spark, sf_dir), SCHEMAS).select("payload_id", "code")


_BODY = "'{\"a\":{\"b\":[\"x' || event_id || '\",{\"c\":\"' || event_type || '\"},3,null]},\"d\":\"é\"}'"


@query(f"WITH b AS (SELECT event_id, ({_BODY})::JSON AS j FROM events), t AS (SELECT event_id, x.fullkey AS k, x.atom AS v, x.type AS y FROM b, json_tree(j) AS x) SELECT event_id, replace(substr(k, 3), '\"', '') AS path, v->>'$' AS value FROM t WHERE y = 'VARCHAR'")
def json_strings_nested(spark, sf_dir):
    """All strings of nested JSON with their paths."""
    i = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"a":{"b":["x'), i, F.lit('",{"c":"'), "event_type", F.lit('"},3,null]},"d":"é"}'))
    return gate.json_strings(read(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body").select("event_id", "path", "value")


# ---- audits
FORMS = ("o'neil/key 77", "O'Neil/Key  77", "o%27neil%2fkey%2077", "bydulwlsl2tlesa3nw==", "6f276e65696c2f6b6579203737", "&#111;&#39;&#110;&#101;&#105;&#108;&#47;&#107;&#101;&#121;&#32;&#55;&#55;", "o&apos;neil&#x2f;key 77", "nothing")


def _audited(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("payload_id"), F.concat(F.lit("say "), pick(FORMS, F.col("event_id")), F.lit(" and more")).alias("body"))


_CHECKS = {"raw": (0,), "normalized": (0, 1), "url_encoded": (), "base64": (), "hex": (4,), "html_entity": (5,)}


@query("SELECT event_id AS payload_id, c AS \"check\", NOT list_contains(CASE c " + " ".join(f"WHEN {q(k)} THEN {list(v)}::BIGINT[]" for k, v in _CHECKS.items()) + " ELSE []::BIGINT[] END, event_id % 8) AS passed FROM events, (SELECT unnest([" + ", ".join(map(q, [*_CHECKS, "payload_size"])) + "]) AS c)")
def audit_checks(spark, sf_dir):
    """Payloads with a secret in one form each: which checks of the audit see it. Only forms of a family that starts as the check expects count."""
    return gate.audit_checks(_audited(spark, sf_dir), spark.createDataFrame([("O'Neil/Key 77",)], "secret string"))


def _audit(spark, sf_dir):
    i = F.col("event_id")
    detection = F.struct(F.lit("regex").alias("type"), F.lit("EMAIL").alias("pii_type"), F.col("value").alias("confidence"), F.when(i % 5 == 0, "a@b.co").when(i % 5 == 1, F.lit(None)).otherwise("⟦EMAIL#1⟧").alias("text_span"), F.when(i % 7 == 0, "no name!").otherwise("recognizers").alias("source_id"), F.lit("page text").alias("raw"))
    egress = F.struct(F.lit("payload_size").alias("check"), (i % 3 == 0).alias("passed"), F.when(i % 9 == 0, "secret").when(i % 3 == 0, F.lit(None)).otherwise(F.concat(i.cast("string"), F.lit(" bytes"))).alias("matched_value"))
    policy = F.struct(F.lit("EMAIL").alias("pii_type"), F.lit("DROP").alias("action"), F.lit("told").alias("cause"))
    record = F.struct(F.array(detection).alias("detections"), F.array(policy).alias("policy"), F.array(egress).alias("egress"), F.array(F.when(i % 4 == 0, "ner timeout: x y").otherwise("ner_timeout")).alias("degraded"))
    return read(spark, sf_dir, "events").select("event_id", record.alias("record"))


@query("SELECT event_id, '{\"detections\":[{\"type\":\"regex\",\"pii_type\":\"EMAIL\",' || CASE event_id % 5 WHEN 0 THEN '\"text_span\":\"a@b.co\",' WHEN 1 THEN '' ELSE '\"text_span\":\"⟦EMAIL#1⟧\",' END || '\"source_id\":\"' || CASE WHEN event_id % 7 = 0 THEN 'no name!' ELSE 'recognizers' END || '\"}],\"policy\":[{\"pii_type\":\"EMAIL\",\"action\":\"DROP\"}]}' AS kept FROM events")
def audit_fields(spark, sf_dir):
    """What an audit keeps of a record; the rest of it never gets there."""
    kept = _audit(spark, sf_dir).select("event_id", gate.audit_fields().alias("a"))
    shown = F.struct(F.transform("a.detections", lambda d: d.dropFields("confidence")).alias("detections"), F.col("a.policy"))
    return kept.select("event_id", F.to_json(shown).alias("kept"))


@query("SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'text_span' END, CASE WHEN event_id % 7 = 0 THEN 'source_id' END, CASE WHEN event_id % 9 = 0 THEN 'matched_value' END, CASE WHEN event_id % 4 = 0 THEN 'degraded' END) AS faults FROM events")
def audit_assert(spark, sf_dir):
    kept = _audit(spark, sf_dir).select("event_id", gate.audit_fields().alias("a"))
    return kept.select("event_id", F.array_join(gate.audit_faults(F.col("a")), ",").alias("faults"))


# ---- canaries and detection
_GRAMS8 = "unnest(list_transform(range(1, greatest(length({0}) - 6, 1)), lambda i: substr({0}, i, 8)))"
_CANARY = f"""{_SECRETS}, d AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t FROM documents), w AS (SELECT doc_id, source, secret, 'raw' AS encoding FROM d JOIN s ON contains(t, secret)),
g AS (SELECT DISTINCT doc_id, source, {_GRAMS8.format('t')} AS g FROM d), p AS (SELECT secret, {_GRAMS8.format('secret')} AS g FROM s), n AS (SELECT doc_id, source, secret, '8-gram' AS encoding FROM g JOIN p USING (g) GROUP BY doc_id, source, secret HAVING count(*) >= 3),
c AS (FROM w UNION ALL SELECT * FROM n ANTI JOIN w USING (doc_id, secret))"""


def _canaries(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("source").alias("run"), F.coalesce("text", F.lit("")).alias("body"))
    runs = docs.select("run").distinct()
    known = registry(spark, sf_dir).crossJoin(F.broadcast(runs)).select("run", F.lit("WORD").alias("type"), F.col("secret").alias("value"))
    return gate.canaries(docs, known)


@query(f"WITH {_CANARY} SELECT doc_id AS request_id, secret AS canary, encoding FROM c")
def canary_scan(spark, sf_dir):
    """Long benchmark words that documents hold, whole or in part."""
    return _canaries(spark, sf_dir).select("request_id", "canary", "encoding")


@query(f"WITH {_CANARY} SELECT source AS run, encoding, count(*)::BIGINT AS leaks, count(DISTINCT secret)::BIGINT AS canaries FROM c GROUP BY ALL")
def leak_report(spark, sf_dir):
    return _canaries(spark, sf_dir).groupBy("run", "encoding").agg(F.count("*").alias("leaks"), F.countDistinct("canary").alias("canaries"))


@query(f"""WITH {_SECRETS}, r AS (SELECT DISTINCT source AS run FROM documents), h AS (SELECT DISTINCT source AS run, secret FROM documents JOIN s ON contains(lower(text), secret)), b AS (SELECT run, length(secret) % 2 = 0 AS decoy, h.secret IS NOT NULL AS leaked FROM r CROSS JOIN s LEFT JOIN h USING (run, secret)),
c AS (SELECT run, count(*) FILTER (NOT decoy AND NOT leaked) AS tp, count(*) FILTER (NOT decoy AND leaked) AS fn, count(*) FILTER (decoy AND NOT leaked) AS fp FROM b GROUP BY 1) SELECT run, tp, fn, fp, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS "precision" FROM c""")
def wire_detection(spark, sf_dir):
    """Benchmark words as values shown, those of even length as decoys, and each source's documents as its wire."""
    wire = read(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.coalesce("text", F.lit("")).alias("body"))
    shown = registry(spark, sf_dir).crossJoin(F.broadcast(wire.select("run").distinct())).select("run", F.lit(0).alias("at"), F.col("secret").alias("value"), (F.length("secret") % 2 == 0).alias("decoy"))
    return gate.detection(wire, shown).withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


# ---- scores of runs
_IOU = f"{_BOTH} / (a.w * a.h + b.w * b.h - {_BOTH})"
_SEEN = "o AS (SELECT obs, id, tag, x + id % 9 AS x, y + id % 5 AS y, w, h FROM el WHERE id % 5 <> 0 UNION ALL SELECT obs, id + 1, tag, x, y, w, h FROM el WHERE id % 7 = 0)"


@query(f"""WITH {EL}, {_SEEN}, p AS (SELECT a.obs, list_sort(list({{'c': a.id, 'o': b.id}})) AS l FROM el a JOIN o b ON a.obs = b.obs AND a.tag = b.tag AND {_MEET} WHERE {_IOU} >= 0.5 GROUP BY 1),
m AS (SELECT obs, len(list_reduce(list_transform(l, lambda x: [x]), lambda done, x: CASE WHEN len(list_filter(done, lambda d: d.c = x[1].c OR d.o = x[1].o)) > 0 THEN done ELSE done || x END))::BIGINT AS matched FROM p) SELECT obs, n.truth, v.observed, coalesce(matched, 0) AS matched FROM (SELECT obs, count(*)::BIGINT AS truth FROM el GROUP BY 1) n JOIN (SELECT obs, count(*)::BIGINT AS observed FROM o GROUP BY 1) v USING (obs) LEFT JOIN m USING (obs)""")
def match_controls(spark, sf_dir):
    """Controls of pages against what was observed of them, moved a little, some missing, some twice."""
    el = elements(spark, sf_dir)
    r = F.col("rect")
    moved = el.where("id % 5 <> 0").select("obs", "ord", "tag", G.rect(r["x"] + F.col("id") % 9, r["y"] + F.col("id") % 5, r["w"], r["h"]).alias("rect"))
    twice = el.where("id % 7 = 0").select("obs", (F.col("ord") + 1).alias("ord"), "tag", "rect")
    return metrics.matched_controls(el.select("obs", "ord", "tag", "rect"), moved.unionByName(twice))


@query(f"""WITH {R}, a AS (SELECT * FROM r WHERE id % 2 = 0), b AS (SELECT *, ['pii', 'region', 'field'][id % 3 + 1] AS kind FROM r WHERE id % 2 = 1), g AS (SELECT DISTINCT a.obs, a.id FROM a JOIN b ON a.obs = b.obs AND {_MEET} WHERE {_IOU} >= 0.3 OR (a.x - 4 <= b.x AND a.y - 4 <= b.y AND a.x + a.w + 4 >= b.x + b.w AND a.y + a.h + 4 >= b.y + b.h) OR (kind = 'field' AND b.x - 4 <= a.x AND b.y - 4 <= a.y AND b.x + b.w + 4 >= a.x + a.w AND b.y + b.h + 4 >= a.y + a.h))
SELECT obs, id, (obs, id) IN (SELECT (obs, id) FROM g) OR id % 10 = 4 AS justified FROM a""")
def redaction_precision(spark, sf_dir):
    r = rects(spark, sf_dir)
    red = r.where("side = 0").select("obs", "id", "rect", F.when(F.col("id") % 10 == 4, "opaque <Canvas>").otherwise("EMAIL from regex").alias("reason"))
    truth = r.where("side = 1").select("obs", F.col("id").alias("tid"), pick(("pii", "region", "field"), F.col("id")).alias("kind"), "rect")
    return metrics.justified(red, truth).select("obs", "id", "justified")


_STEP = "s AS (SELECT user_id AS run, event_id, value * 2 + CASE WHEN event_type = 'click' THEN value ELSE 0 END AS local_ms, value * 3 AS latency, event_id % 5 * 100 AS bytes FROM events)"
_P = lambda v, p, w="true": f"(list_sort(list({v}) FILTER ({w})))[least(count(*) FILTER ({w}) - 1, floor(count(*) FILTER ({w}) * {p})::INT) + 1]"
_RUNS = f"{_STEP}, u AS (SELECT run, count(*)::BIGINT AS steps, floor(sum(local_ms) / count(*) + 0.5)::BIGINT AS local_ms, coalesce({_P('bytes', 0.5, 'bytes > 0')}, 0) AS bytes_p50, {_P('latency', 0.5)} AS p50, {_P('latency', 0.95)} AS p95 FROM s GROUP BY 1)"


def _runs(spark, sf_dir):
    """Steps of runs; a step's timings are a map of whatever was measured."""
    v = F.col("value")
    timings = F.map_filter(F.create_map(F.lit("observe"), v, F.lit("gate"), v, F.lit("reason"), v * 100, F.lit("execute"), F.when(F.col("event_type") == "click", v)), lambda k, x: x.isNotNull())
    steps = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), timings.alias("timings"), (v * 3).alias("latency"), (F.col("event_id") % 5 * 100).alias("bytes"))
    here = F.map_entries(F.map_filter("timings", lambda k, x: k.isin(*schema.LOCAL_TIMINGS)))
    # a run of which nothing was measured has no mean
    local = F.aggregate(here, F.lit(None).cast("double"), lambda s, e: F.coalesce(s, F.lit(0.0)) + e["value"])
    # added as decimals, which come out the same in any order: sums of doubles tell halves by chance
    total = F.sum(local.cast("decimal(28,9)"))
    per = steps.groupBy("run").agg(F.count("*").alias("steps"), F.floor(total / F.count("*") + F.expr("0.5BD")).cast("long").alias("local_ms"))
    size = metrics.floor_percentiles(steps.where("bytes > 0"), "run", "bytes", {"bytes_p50": 0.5})
    late = metrics.floor_percentiles(steps, "run", "latency", {"p50": 0.5, "p95": 0.95})
    for shares in (size, late):
        per = per.join(shares.withColumnRenamed("run", "__run"), F.col("run").eqNullSafe(F.col("__run")), "left").drop("__run")
    return per.withColumn("bytes_p50", F.coalesce("bytes_p50", F.lit(0)))


@query(f"WITH {_RUNS} SELECT run, steps, local_ms, bytes_p50 FROM u")
def run_resources(spark, sf_dir):
    return _runs(spark, sf_dir).select("run", "steps", "local_ms", "bytes_p50")


@query(f"WITH {_RUNS} SELECT run, p50, p95 FROM u")
def run_latency(spark, sf_dir):
    return _runs(spark, sf_dir).select("run", "p50", "p95")


@query(f"WITH {_RUNS} SELECT count(*)::BIGINT AS runs, floor(avg(local_ms) + 0.5)::BIGINT AS local_ms, floor(avg(bytes_p50) + 0.5)::BIGINT AS bytes_p50, floor(avg(p50) + 0.5)::BIGINT AS p50, floor(avg(p95) + 0.5)::BIGINT AS p95, round(avg((run % 3 = 0)::INT), 6) AS completion FROM u")
def score_suite(spark, sf_dir):
    """Means over runs, rounded."""
    runs = _runs(spark, sf_dir)
    return runs.agg(F.count("*").alias("runs"), *[F.floor(F.avg(c) + 0.5).alias(c) for c in ("local_ms", "bytes_p50", "p50", "p95")], F.round(F.avg((F.col("run") % 3 == 0).cast("int")), 6).alias("completion"))


_BAL = schema.PROFILES["BALANCED"]
_WEIGHT = "CASE type " + " ".join(f"WHEN {q(t)} THEN CASE config " + " ".join(f"WHEN {q(k)} THEN {float(c.get(t, _BAL[t]))}" for k, c in schema.ABLATIONS.items()) + " END" for t in _KINDS) + " END"


@query(f"""WITH {R}, d AS (SELECT obs, id // 100 AS anchor, {_pick(_KINDS, 'id // 10')} AS type, id % 89 / 210 AS confidence, ['dom', 'pixel'][obs % 2 + 1] AS channel FROM r WHERE id % 2 = 0), c AS (SELECT unnest([{', '.join(map(q, schema.ABLATIONS))}]) AS config),
s AS (SELECT config, obs, anchor, any_value(channel) AS channel, round(1 - product(1 - least(1, {_WEIGHT} * confidence)), 9) AS s FROM d, c GROUP BY config, obs, anchor) SELECT config, channel, count(*)::BIGINT AS n, count(*) FILTER (s >= {_BAL['tokenize']})::BIGINT AS found, round(count(*) FILTER (s >= {_BAL['tokenize']}) / count(*), 6) AS recall FROM s GROUP BY GROUPING SETS ((config, channel), (config))""")
def frontier(spark, sf_dir):
    """What each of nine weightings of the sources would still act on, by channel and over all."""
    seen, _ = _evidence(spark, sf_dir)
    terms = seen.select("obs", F.floor(F.col("ord") / 100).alias("anchor"), pick(("dom", "pixel"), F.col("obs")).alias("channel"), "type", "confidence")
    out = metrics.ablated(terms, {k: _BAL[k] for k in _KINDS}, schema.ABLATIONS, _BAL["tokenize"])
    return out.withColumn("recall", F.round("recall", 6))


# ---- a planner's actions
ACTS = ("CLICK", "TYPE", "SELECT", "NAVIGATE", "SCROLL", "DONE")
VALUES, SHOWN = ("vault_ref", "literal", "user_input"), ("⟦EMAIL#1⟧", "⟦CITY#2⟧", "EMAIL")
_CAN = "CASE WHEN tag IN ('input', 'textarea') THEN ['CLICK', 'TYPE', 'SCROLL', 'PRESS_KEY'] WHEN tag = 'select' THEN ['CLICK', 'SELECT', 'SCROLL', 'PRESS_KEY'] ELSE ['CLICK', 'SCROLL', 'PRESS_KEY'] END"
_CLASS = "CASE WHEN id % 4 = 0 THEN 'EMAIL' WHEN id % 4 = 2 THEN 'CITY' END"
_ACT = f"""ac AS (SELECT obs, id, tag, visible, enabled, label_raw, {_CAN} AS can, {_pick(ACTS, 'id // 10 % 7 + id // 1000')} AS kind, id % 16 = 6 AS stale, id % 18 = 4 AS lost, id % 20 = 8 AS other, {_pick(VALUES, 'id // 1000')} AS vk, {_pick(SHOWN, 'id // 100')} AS handle, {_CLASS} AS cls, id % 12 = 2 AS secret FROM el)"""
_BINDS = "CASE WHEN handle = 'EMAIL' THEN 'NONE' ELSE regexp_extract(handle, '⟦([^#⟧]+)[#⟧]', 1) END"


def _proposed(spark, sf_dir):
    i = F.col("id")
    el = elements(spark, sf_dir).withColumns({"available_actions": context.actions(), "id_hash": F.concat(F.lit("h"), (i % 97).cast("string")), "sensitivity_class": F.when(i % 4 == 0, "EMAIL").when(i % 4 == 2, "CITY")})
    kind = pick(ACTS, F.floor(i / 10) % 7 + F.floor(i / 1000))
    asked = el.select(
        i.alias("action_id"), "obs", F.when(i % 16 == 6, F.col("obs") + 1).otherwise(F.col("obs")).alias("current_obs"), kind.alias("type"), F.when(kind.isin("NAVIGATE", "DONE"), F.lit(None)).when(i % 18 == 4, -i).otherwise(i).alias("target_id"), F.when(i % 20 == 8, "x").otherwise(F.col("id_hash")).alias("target_hash"),
        F.when(i % 3 == 0, "https://x.org/").otherwise("/here").alias("url"), pick(VALUES, F.floor(i / 1000)).alias("value_kind"), pick(SHOWN, F.floor(i / 100)).alias("handle"), (i % 12 == 2).alias("secret"), "label_raw",
    )
    return asked, el


_AIMED = "kind NOT IN ('NAVIGATE', 'DONE')"


@query(f"""WITH {EL}, {_ACT} SELECT id AS action_id, CASE WHEN stale THEN 'STALE_OBSERVATION' WHEN {_AIMED} AND lost THEN 'UNKNOWN_TARGET' WHEN {_AIMED} AND other THEN 'IDENTITY_MISMATCH' WHEN {_AIMED} AND NOT visible THEN 'ELEMENT_OBSCURED' WHEN {_AIMED} AND NOT enabled THEN 'ELEMENT_DISABLED'
  WHEN {_AIMED} AND kind NOT IN ('PRESS_KEY', 'SCROLL') AND NOT list_contains(can, kind) THEN 'UNSUPPORTED_ACTION' WHEN kind = 'NAVIGATE' AND id % 3 = 0 THEN 'ORIGIN_NOT_ALLOWED' WHEN kind = 'TYPE' AND vk = 'vault_ref' AND NOT CASE {_BINDS} WHEN 'NONE' THEN false WHEN 'EMAIL' THEN coalesce(cls = 'EMAIL', false) ELSE coalesce(cls = 'CITY', true) END THEN 'VAULT_TYPE_MISMATCH'
  WHEN kind = 'TYPE' AND vk = 'literal' AND secret THEN 'LITERAL_CONTAINS_SECRET' WHEN kind = 'TYPE' AND vk = 'user_input' THEN 'UNSUPPORTED_ACTION' END AS code FROM ac""")
def validate_action(spark, sf_dir):
    asked, el = _proposed(spark, sf_dir)
    return actions.validate(asked.drop("label_raw"), el).select("action_id", "code")


@query(f"WITH {EL}, {_ACT} SELECT id AS action_id, CASE WHEN kind = 'TYPE' AND vk = 'vault_ref' THEN CASE WHEN lost THEN 'UNKNOWN_TARGET' WHEN NOT CASE {_BINDS} WHEN 'NONE' THEN false WHEN 'EMAIL' THEN coalesce(cls = 'EMAIL', false) ELSE coalesce(cls = 'CITY', true) END THEN 'VAULT_TYPE_MISMATCH' END END AS code FROM ac")
def vault_type_match(spark, sf_dir):
    asked, el = _proposed(spark, sf_dir)
    met = actions._target(asked.drop("label_raw"), el)
    return met.select("action_id", actions.vault_type_match(F.col("type"), F.col("__e"), F.col("value_kind"), F.col("handle")).alias("code"))


SAYS = ("Pay now", "Delete account", "Next", "Place order", "Unsubscribe me")


@query(f"WITH {EL}, {_ACT}, p AS (SELECT id, kind, {_pick(SAYS, 'id // 10')} AS label, id % 6 = 0 AS flagged, CASE WHEN id % 10 = 0 THEN 'high' ELSE 'low' END AS risk FROM ac) SELECT id AS action_id, CASE WHEN kind = 'NAVIGATE' THEN true WHEN kind = 'CLICK' AND label <> 'Next' THEN true ELSE flagged OR risk = 'high' END AS confirm, CASE WHEN kind = 'NAVIGATE' OR (kind = 'CLICK' AND label <> 'Next') OR flagged OR risk = 'high' THEN 'high' ELSE 'low' END AS level FROM p")
def risk_of(spark, sf_dir):
    asked, _ = _proposed(spark, sf_dir)
    i = F.col("action_id")
    r = actions.risk_of(F.col("type"), pick(SAYS, F.floor(i / 10)), i % 6 == 0, F.when(i % 10 == 0, "high").otherwise("low"))
    return asked.select("action_id", r.alias("r")).select("action_id", "r.confirm", "r.level")


@query(f"""WITH {EL}, {_ACT} SELECT id AS action_id, CASE WHEN id % 14 = 0 THEN 'INVALID' WHEN stale THEN 'STALE_OBSERVATION' WHEN {_AIMED} AND lost THEN 'UNKNOWN_TARGET' WHEN {_AIMED} AND other THEN 'IDENTITY_MISMATCH' WHEN {_AIMED} AND NOT visible THEN 'ELEMENT_NOT_VISIBLE' WHEN {_AIMED} AND kind NOT IN ('PRESS_KEY', 'SCROLL') AND NOT list_contains(can, kind) THEN 'UNSUPPORTED_ACTION'
  WHEN kind = 'TYPE' AND vk = 'vault_ref' AND handle <> '⟦EMAIL#1⟧' THEN 'UNKNOWN_HANDLE' WHEN kind = 'DONE' AND id % 4 = 2 THEN 'UNKNOWN_TARGET' END AS error, CASE WHEN id % 10 = 0 THEN 'high' ELSE 'low' END AS risk FROM ac""")
def guard_envelope(spark, sf_dir):
    """A planner's answers with gaps: no type, no hash, no observation, no risk; handles and evidence that aren't there."""
    asked, el = _proposed(spark, sf_dir)
    i = F.col("action_id")
    said = asked.select("action_id", "obs", F.when(i % 16 == 6, F.col("obs") + 1).otherwise(F.lit(None)).alias("said_obs"), F.when(i % 14 != 0, F.col("type")).alias("type"), "target_id", F.when(F.col("target_hash") == "x", "x").otherwise("").alias("target_hash"), F.when(i % 10 == 0, "high").alias("risk"), F.lit(None).cast("boolean").alias("requires_confirmation"), "value_kind", "handle", F.when(i % 4 == 2, -i).otherwise(i).alias("evidence"))
    known = el.select("obs").distinct().withColumn("handle", F.lit("⟦EMAIL#1⟧"))
    return actions.guard(said, el, known).select("action_id", "error", "risk")


@query(f"""WITH {EL}, l AS (SELECT obs, id, visible AND (tag IN ('input', 'textarea', 'select', 'button', 'a') OR role IN ('textbox', 'searchbox', 'button', 'link') OR id % 4 = 0 OR label_raw <> '') AS shown, '  ' || concat_ws(' ', id, '<' || tag || ' type=' || type || ' role=' || role || '>', CASE WHEN label_raw <> '' THEN '<untrusted_page_content>' || label_raw || '</untrusted_page_content>' END, CASE WHEN id % 4 = 0 THEN 'accepts=EMAIL' END, CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN tag IN ('input', 'textarea') THEN 'actions=TYPE' WHEN tag = 'select' THEN 'actions=SELECT' END, 'id_hash=h' || id % 97) AS line FROM el)
SELECT obs, md5('Elements (' || count(*) FILTER (shown) || ' you can act on, of ' || count(*) || ' observed):' || coalesce(string_agg(chr(10) || line, '' ORDER BY id) FILTER (shown), '')) AS prompt FROM l GROUP BY 1""")
def prompt_assemble(spark, sf_dir):
    i = F.col("id")
    el = elements(spark, sf_dir).withColumns({"available_actions": context.actions(), "id_hash": F.concat(F.lit("h"), (i % 97).cast("string")), "sensitivity_class": F.when(i % 4 == 0, "EMAIL"), "placeholder_raw": F.lit(None).cast("string")})
    return actions.prompt(el.withColumn("id", i.cast("string"))).select("obs", F.md5("prompt").alias("prompt"))


PREDICATES = ("url_matches", "field_values", "page_contains", "cart_contains", "outcome", "blocked_with")


@query(f"""WITH p AS (SELECT conv_id, turn, {_pick(PREDICATES, 'conv_id + turn')} AS kind, coalesce(text, '') AS text FROM conversations) SELECT conv_id, turn, kind, CASE kind WHEN 'url_matches' THEN regexp_matches('/orders/' || conv_id, '^/orders/[0-9]*7$') WHEN 'field_values' THEN conv_id % 3 = 0 WHEN 'page_contains' THEN contains(lower(text), 'the') WHEN 'cart_contains' THEN conv_id % 5 = 0 WHEN 'outcome' THEN turn % 2 = 0 ELSE conv_id % 4 = 1 END AS passed FROM p""")
def predicates(spark, sf_dir):
    c, n = F.col("conv_id"), F.col("turn")
    kind = pick(PREDICATES, c + n)
    wanted = F.create_map(F.lit("#city"), F.lit("Pune "))
    fields = F.when(kind == "cart_contains", F.create_map(F.when(c % 5 == 0, "sku-1").otherwise("sku-2"), F.lit(""))).otherwise(F.create_map(F.lit("#city"), F.when(c % 3 == 0, " Pune").otherwise("Nagpur")))
    pattern = F.when(kind == "url_matches", "^/orders/[0-9]*7$").when(kind == "page_contains", "The").when(kind == "cart_contains", "sku-1").when(kind == "blocked_with", "STALE")
    codes = F.when(c % 4 == 1, F.array(F.lit("x"), F.lit("STALE"))).otherwise(F.array(F.lit("x")))
    ok = actions.predicate(kind, F.concat(F.lit("/orders/"), c.cast("string")), F.coalesce("text", F.lit("")), pattern, fields, wanted, F.when(n % 2 == 0, "success").otherwise("failure"), codes)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), ok.alias("passed"))


# the twin of relational.gate_rate, whose history is the same recursion
ORACLES["gate_rate"] = f"WITH e AS (SELECT event_id AS i, user_id AS s, epoch_ms(ts) AS ms, NULL::VARCHAR AS early, true AS pinned FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ms, i) AS n FROM e), {_LIMITED.format(window=WINDOW, most=MOST)} SELECT s AS user_id, i AS event_id, ok AS accepted FROM rate"
