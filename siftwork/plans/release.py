"""Queries of the release checks. Documents are payloads, long words of the benchmark the registry of secrets."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import fusion, gate, metrics
from siftwork.plans.probes import RULES, _ENTROPY, found_sql, q
from siftwork.plans import relational
from siftwork.plans.relational import _evidence, _pick, _KINDS, _TYPES, R

_NAMES = ("email", "card")
_SECRETS = "s AS (SELECT DISTINCT w AS secret FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{11,}')) AS w FROM benchmark))"
LIMIT = 8000


def registry(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{11,}"), F.lit(0))).alias("secret"))
    return words.distinct()


def payloads(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("payload_id"), F.coalesce("text", F.lit("")).alias("body"))


def strings(spark, sf_dir):
    """The words of a payload are its released strings."""
    return payloads(spark, sf_dir).select("payload_id", F.explode(F.regexp_extract_all("body", F.lit(r"[^ \t\n\x0b\x0c\r]+"), F.lit(0))).alias("value"))


def gate_registry(spark, sf_dir):
    whole = payloads(spark, sf_dir).withColumnRenamed("body", "value")
    return gate.registry_scan(whole, registry(spark, sf_dir), fragments=False).select("payload_id", "code")


def gate_registry_whole(spark, sf_dir):
    """gate_registry with fragments of secrets."""
    whole = payloads(spark, sf_dir).withColumnRenamed("body", "value")
    return gate.registry_scan(whole, registry(spark, sf_dir)).select("payload_id", "code")


def gate_sweep(spark, sf_dir):
    return gate.sweep(payloads(spark, sf_dir).withColumnRenamed("body", "value"), _NAMES).select("payload_id", "code")


def gate_sweep_whole(spark, sf_dir):
    """gate_sweep with all recognizers."""
    return gate.sweep(payloads(spark, sf_dir).withColumnRenamed("body", "value")).select("payload_id", "code")


def gate_verdict(spark, sf_dir):
    p = payloads(spark, sf_dir)
    whole = p.withColumnRenamed("body", "value")
    return gate.verdicts(p, gate.registry_scan(whole, registry(spark, sf_dir), fragments=False), gate.sweep(whole, _NAMES), gate.entropy(strings(spark, sf_dir)), gate.size(p, LIMIT))


def gate_verdict_whole(spark, sf_dir):
    """gate_verdict with fragments of secrets and all recognizers."""
    p = payloads(spark, sf_dir)
    whole = p.withColumnRenamed("body", "value")
    return gate.verdicts(p, gate.registry_scan(whole, registry(spark, sf_dir)), gate.sweep(whole), gate.entropy(strings(spark, sf_dir)), gate.size(p, LIMIT))


def gate_destination(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("payload_id"), F.col("url").alias("destination"))
    return gate.verdicts(p, gate.destination(p, "http://tionsh.example.net"))


def literal_scan(spark, sf_dir):
    return gate.literal_scan(payloads(spark, sf_dir).withColumnRenamed("body", "value"), registry(spark, sf_dir))


def payload_scan(spark, sf_dir):
    """Is the page's own path in its page, in any encoding of it?"""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.size(F.filter(gate.payload_scan(F.col("html"), F.regexp_extract("url", "//([^/]+)", 1)), lambda x: x["found"] & x["long"])).cast("long").alias("n_found"))


def handle_consistency(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    used = ev.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("handle")).distinct()
    declared = ev.where("user_id % 3 <> 0").select(F.concat(F.lit("h"), (F.col("user_id") + 1).cast("string")).alias("handle"), F.when(F.col("user_id") % 7 == 0, F.col("event_type")).otherwise("a").alias("type")).distinct()
    return gate.handle_consistency(used, declared)


def score_privacy(spark, sf_dir):
    """How many long benchmark words each source's documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("run"), F.coalesce("text", F.lit("")).alias("body"))
    runs = docs.select("run").distinct()
    truth = registry(spark, sf_dir).withColumnRenamed("secret", "value").withColumn("tier", F.when(F.length("value") > 12, 1).otherwise(2))
    named = truth.crossJoin(F.broadcast(runs))
    return gate.leakage(docs, named)


def mlp_forward(spark, sf_dir):
    """A 4-8-2 network with weights by a rule, on the first four components."""
    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    out = gate.mlp(x, *weights())
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(F.get(out, 0), 6).alias("a"), F.round(F.get(out, 1), 6).alias("b"))


def weights():
    rule = lambda i, j: round(math.sin(7 * i + 3 * j + 1) * 0.1, 6)
    return [[rule(i, j) for j in range(4)] for i in range(8)], [rule(i, 9) for i in range(8)], [[rule(i + 20, j) for j in range(8)] for i in range(2)], [rule(i + 20, 9) for i in range(2)]


def ablation(spark, sf_dir):
    """Mean evidence term with one source's weight at zero, for each source, and with all; nine rows at most."""
    seen, _ = _evidence(spark, sf_dir)
    p = schema.PROFILES["STRICT"]
    without = F.explode(F.array(*map(F.lit, ("none", *_KINDS))))
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(p[k])) for k in _KINDS])
    term = F.when(F.col("type") == F.col("without"), 0.0).otherwise(weight * F.col("confidence"))
    return seen.withColumn("without", without).groupBy("without").agg(F.round(F.avg(fusion.clamp01(term)), 6).alias("mean_term"), F.count_if(term >= p["tokenize"]).alias("tokenized"))


def json_strings(spark, sf_dir):
    """The members of the events' JSON as (path, value)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


def perf_delta(spark, sf_dir):
    """Mean value of each kind of event against the first half's."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = ev.where("event_id % 2 = 0").groupBy("event_type").agg(F.avg("value").alias("base"))
    return ev.groupBy("event_type").agg(F.avg("value").alias("now")).join(base, "event_type", "left").select("event_type", F.round(F.col("now") - F.col("base"), 6).alias("delta"))


def span_f1(spark, sf_dir):
    """Card-shaped numbers against valid cards, document by document."""
    from siftwork.operators import recognize
    from siftwork.functions.text import spans

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shaped = docs.select("doc_id", F.posexplode(spans(F.col("text"), schema.PATTERNS["card"])).alias("ord", "s")).select("doc_id", "ord", "s.start", "s.end", F.lit("CARD").alias("type"))
    valid = docs.select("doc_id", F.posexplode(recognize.card(F.col("text"))).alias("ord", "s")).select("doc_id", "ord", "s.start", "s.end", F.lit("CARD").alias("type"))
    return metrics.matched(shaped, valid)


QUERIES = {f.__name__: f for f in (gate_registry, gate_registry_whole, gate_sweep, gate_sweep_whole, gate_verdict, gate_verdict_whole, gate_destination, literal_scan, payload_scan, handle_consistency, score_privacy, mlp_forward, ablation, json_strings, perf_delta, span_f1)}
_P = "probe AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_REG = "g AS (SELECT DISTINCT doc_id AS payload_id FROM documents JOIN s ON contains(lower(text), secret))"
_SWEEP = f"{_P}, {', '.join(map(found_sql, _NAMES))}, w AS (SELECT DISTINCT doc_id AS payload_id FROM ({' UNION ALL '.join(f'SELECT doc_id FROM {n}' for n in _NAMES)}))"
# all recognizers whose finds identify or are secret: the one without a rule in SQL finds neither
_STRONG = tuple(n for n in RULES if n not in ("ipv4", "ipv6_full", "dob_iso", "dob_us"))
_SWEEP_ALL = f"{_P}, {', '.join(map(found_sql, _STRONG))}, w AS (SELECT DISTINCT doc_id AS payload_id FROM ({' UNION ALL '.join(f'SELECT doc_id FROM {n}' for n in _STRONG)}))"
_EIGHT = "unnest(list_distinct(list_transform(range(1, greatest(length({0}) - 6, 1)), lambda i: substr({0}, i, 8))))"
_FRAGMENTS = f"dg AS (SELECT doc_id, {_EIGHT.format('lower(text)')} AS g FROM documents), sg AS (SELECT DISTINCT g FROM (SELECT {_EIGHT.format('secret')} AS g FROM s)), g AS (SELECT DISTINCT doc_id AS payload_id FROM dg SEMI JOIN sg USING (g))"
_HOST = "regexp_extract(url, '//([^/]+)', 1)"
_W1, _B1, _W2, _B2 = weights()
_X = "[embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE]"
_HID = ", ".join(f"greatest(0, {' + '.join(f'x[{j + 1}] * ({w})' for j, w in enumerate(row))} + ({b})) AS h{i}" for i, (row, b) in enumerate(zip(_W1, _B1, strict=True)))
_OUT = ", ".join(f"round({' + '.join(f'h{j} * ({w})' for j, w in enumerate(row))} + ({b}), 6) AS {n}" for n, row, b in zip("ab", _W2, _B2, strict=True))
_S = schema.PROFILES["STRICT"]
ORACLES = {
    "gate_registry": f"WITH {_SECRETS}, {_REG} SELECT payload_id, 'REGISTRY_SCAN' AS code FROM g",
    "gate_sweep": f"WITH {_SWEEP} SELECT payload_id, 'TYPE_BRAND' AS code FROM w",
    "gate_verdict": f"""WITH {_SECRETS}, {_REG}, {_SWEEP}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r]+')) AS word FROM documents), k AS (SELECT doc_id, unnest(string_split(word, '/')) AS value FROM t WHERE NOT regexp_matches(word, '⟦|^https?://')),
n AS (SELECT DISTINCT doc_id AS payload_id FROM k WHERE length(value) >= 24 AND round({_ENTROPY}, 9) > 4.0)
SELECT doc_id AS payload_id, CASE WHEN doc_id IN (FROM g) THEN 'REGISTRY_SCAN' WHEN doc_id IN (FROM w) THEN 'TYPE_BRAND' WHEN doc_id IN (FROM n) THEN 'ENTROPY_HEURISTIC' WHEN octet_length(encode(coalesce(text, ''))) > {LIMIT} THEN 'SIZE_BUDGET' END AS code FROM documents""",
    "gate_verdict_whole": f"""WITH {_SECRETS}, {_FRAGMENTS}, {_SWEEP_ALL}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r]+')) AS word FROM documents), k AS (SELECT doc_id, unnest(string_split(word, '/')) AS value FROM t WHERE NOT regexp_matches(word, '⟦|^https?://')),
n AS (SELECT DISTINCT doc_id AS payload_id FROM k WHERE length(value) >= 24 AND round({_ENTROPY}, 9) > 4.0)
SELECT doc_id AS payload_id, CASE WHEN doc_id IN (FROM g) THEN 'REGISTRY_SCAN' WHEN doc_id IN (FROM w) THEN 'TYPE_BRAND' WHEN doc_id IN (FROM n) THEN 'ENTROPY_HEURISTIC' WHEN octet_length(encode(coalesce(text, ''))) > {LIMIT} THEN 'SIZE_BUDGET' END AS code FROM documents""",
    "gate_registry_whole": f"WITH {_SECRETS}, {_FRAGMENTS} SELECT payload_id, 'REGISTRY_SCAN' AS code FROM g",
    "gate_sweep_whole": f"WITH {_SWEEP_ALL} SELECT payload_id, 'TYPE_BRAND' AS code FROM w",
    "gate_destination": "SELECT page_id AS payload_id, CASE WHEN starts_with(url, 'http://tionsh.example.net/') THEN NULL ELSE 'DESTINATION_PIN' END AS code FROM pages",
    "handle_consistency": """WITH u AS (SELECT DISTINCT 'h' || user_id AS handle FROM events), d AS (SELECT DISTINCT 'h' || (user_id + 1) AS handle, CASE WHEN user_id % 7 = 0 THEN event_type ELSE 'a' END AS type FROM events WHERE user_id % 3 <> 0)
SELECT handle, 'dangling' AS problem FROM u WHERE handle NOT IN (SELECT handle FROM d) UNION ALL SELECT DISTINCT handle, 'unreferenced' FROM d WHERE handle NOT IN (FROM u) UNION ALL SELECT handle, 'ambiguous' FROM d GROUP BY handle HAVING count(DISTINCT type) > 1""",
    "score_privacy": f"""WITH {_SECRETS}, r AS (SELECT DISTINCT source AS run FROM documents), h AS (SELECT DISTINCT source AS run, secret FROM documents JOIN s ON contains(lower(text), secret))
SELECT run, count(*)::BIGINT AS n, count(h.secret)::BIGINT AS leaked, count(h.secret) FILTER (length(s.secret) > 12)::BIGINT AS tier1 FROM r CROSS JOIN s LEFT JOIN h USING (run, secret) GROUP BY run""",
    "mlp_forward": f"WITH e AS (SELECT vec_id, {_X} AS x FROM embeddings), h AS (SELECT vec_id, {_HID} FROM e) SELECT vec_id, {_OUT} FROM h",
    "ablation": f"""WITH {R}, d AS (SELECT {_pick(_KINDS, 'id // 10')} AS type, id % 89 / 210 AS confidence FROM r WHERE id % 2 = 0), c AS (SELECT unnest([{', '.join(map(q, ('none', *_KINDS)))}]) AS without),
t AS (SELECT without, CASE WHEN type = without THEN 0 ELSE confidence * CASE type {' '.join(f"WHEN '{k}' THEN {_S[k]}" for k in _KINDS)} END END AS term FROM d, c) SELECT without, round(avg(least(term, 1)), 6) AS mean_term, count(*) FILTER (term >= {_S['tokenize']})::BIGINT AS tokenized FROM t GROUP BY 1""",
    "json_strings": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "perf_delta": "WITH b AS (SELECT event_type, avg(value) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT event_type, round(avg(value) - any_value(base), 6) AS delta FROM events LEFT JOIN b USING (event_type) GROUP BY 1",
}
# a host in any of its encodings, by the twin of encodings()
_FORMS = re.search(r"list_distinct\(.*?lower\(f\)\)\)", relational.ORACLES["encodings"], re.S)[0]
ORACLES["payload_scan"] = f"WITH p AS (SELECT page_id, {_HOST} AS host, lower(html) AS body FROM pages), f AS (SELECT page_id, body, {re.sub(r'\burl\b', 'host', _FORMS)} AS forms FROM p) SELECT page_id, len(list_filter(forms, lambda x: length(x) >= 4 AND contains(body, x)))::BIGINT AS n_found FROM f"
