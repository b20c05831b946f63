"""What may leave: checks of outgoing records, the first violation of each, audits and scores of what was released."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.functions import checks
from siftwork.functions import text as T

from . import contain, recognize, sessions, shape

#: In the order in which the first violation is looked for.
ORDER = ("SCHEMA_CONFORMANCE", "REGISTRY_SCAN", "TYPE_BRAND", "ENTROPY_HEURISTIC", "SIZE_BUDGET", "RATE_LIMIT", "DESTINATION_PIN")

#: Characters of a secret that give it away.
GRAM = 8


def violation(rows: DataFrame, code: str) -> DataFrame:
    """rows(payload_id) as violations of a kind, each payload once."""
    return rows.select("payload_id").distinct().select("payload_id", F.lit(ORDER.index(code)).alias("seq"), F.lit(code).alias("code"))


def json_strings(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, nth, path, value): all strings of JSON texts in document order, paths as a.b[0].c. Texts that aren't JSON, or nested more deeply than the parser goes, have none (and no shape either)."""

    def walk(top):
        todo = [("", top)]
        while todo:
            path, x = todo.pop()
            if isinstance(x, str):
                yield path, x
            elif isinstance(x, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(x.items())]
            elif isinstance(x, list):
                todo += [(f"{path}[{k}]", x[k]) for k in reversed(range(len(x)))]

    def read(text: str | None):
        try:
            return list(walk(json.loads(text or "null")))
        except (ValueError, RecursionError):  # the parser's own depth
            return []

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [read(t) for t in part.column(1).to_pylist()]
                take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                flat = [(n, *s) for f in found for n, s in enumerate(f)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), *[pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]], names=[key, "nth", "path", "value"])

    return rows.select(key, json_col).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, nth long, path string, value string")


def schema_check(payloads: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Violations of payloads(payload_id, path, body): a path's body must be of its shape (see shape.py), which is closed at every depth; a path without one takes no body."""
    bad = F.col("body").isNotNull()
    for path, closed in schemas.items():
        bad = F.when(F.col("path") == path, F.size(shape.faults("body", closed)) > 0).otherwise(bad)
    return violation(payloads.where(bad), "SCHEMA_CONFORMANCE")


def released(strings: DataFrame) -> DataFrame:
    """strings(payload_id, path, value) that are looked through for secrets: not the names of the protocol, and four characters or more."""
    return strings.where(~F.col("path").rlike(schema.PROTOCOL_PATH) & (F.length("value") >= 4))


def malformed(strings: DataFrame) -> DataFrame:
    """Violations of strings at paths of handles that aren't handles."""
    return violation(strings.where(F.col("path").endswith(".handle") & ~F.col("value").rlike(r"^⟦[A-Z_]+(#[0-9]+)?⟧$")), "TYPE_BRAND")


def gate(payloads: DataFrame, registry: DataFrame, schemas: dict[str, dict], allowed: str, limit: int = schema.MAX_PAYLOAD_BYTES, window: int = schema.RATE_WINDOW_MS, most: int = schema.RATE_MAX_SENDS) -> DataFrame:
    """(payload_id, code) of payloads(payload_id, session, ms, path, body, destination): the first check that fails, null for what may leave. Only what may leave
    counts for the rate. registry(secret, tier): words of ordinary pages are no secrets where their tier is three or more."""
    strings = json_strings(payloads, "payload_id", "body")
    shown = strings.where(~F.col("path").rlike(schema.OPAQUE_PATH))
    secrets = registry.where((F.col("tier") < 3) | ~F.lower("secret").isin(*schema.GENERIC_WORDS))
    found = [schema_check(payloads, schemas), registry_scan(released(strings).select("payload_id", "value"), secrets), malformed(shown), sweep(shown), entropy(shown), size(payloads, limit)]
    early = reduce(DataFrame.unionByName, found).groupBy("payload_id").agg(F.min(F.struct("seq", "code"))["code"].alias("early"))
    pinned = F.coalesce(origin(F.col("destination")) == allowed, F.lit(False))
    rows = payloads.select("payload_id", "session", "ms", pinned.alias("pinned")).join(early, "payload_id", "left")
    asked = rows.where("early IS NULL")
    rate = sessions.rate_limit(asked, "session", "ms", "payload_id", window, most, counts="pinned").select("payload_id", "accepted")
    code = F.coalesce("early", F.when(~F.col("accepted"), "RATE_LIMIT"), F.when(~F.col("pinned"), "DESTINATION_PIN"))
    return rows.join(rate, "payload_id", "left").select("payload_id", code.alias("code"))


def audit_fields(record: str = "record") -> Column:
    """The parts of a record that an audit may keep, told one by one: struct<detections, policy, egress, degraded>."""
    part = lambda name, *keep: F.transform(F.col(record)[name], lambda d: F.struct(*[d[k].alias(k) for k in keep])).alias(name)
    return F.struct(part("detections", "type", "pii_type", "confidence", "text_span", "source_id"), part("policy", "pii_type", "action"), part("egress", "check", "passed", "matched_value"), F.col(record)["degraded"].alias("degraded"))


def audit_faults(audit: Column) -> Column:
    """array<string>: what in audit_fields() could carry a page's content: spans must be handles, sources and reasons names, matched values counts of bytes."""
    bad = lambda part, name, test: F.when(F.exists(F.coalesce(part, F.array()), lambda x: F.coalesce(test(x), F.lit(False))), name)
    faults = F.array(
        bad(audit["detections"], "text_span", lambda d: ~d["text_span"].rlike(r"^⟦[A-Z_]+(#[0-9]+)?⟧$")), bad(audit["detections"], "source_id", lambda d: ~d["source_id"].rlike("(?i)^[a-z0-9_-]+$")),
        bad(audit["egress"], "matched_value", lambda e: ~e["matched_value"].rlike("^[0-9]+ bytes$")), bad(audit["degraded"], "degraded", lambda d: ~d.rlike("(?i)^[a-z0-9_:-]+$")),
    )
    return F.filter(faults, lambda f: f.isNotNull())


#: Checks of audit_checks(), in order.
AUDIT_CHECKS = ("raw", "normalized", "url_encoded", "base64", "hex", "html_entity")


def form_family(form: Column) -> Column:
    """Which check an encoded form belongs to, null for none."""
    return F.when(form.startswith("%"), "url_encoded").when(form.startswith("&"), "html_entity").when(form.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(form) % 4 == 0), "base64").when(form.rlike("^[0-9a-fA-F]+$"), "hex")


def audit_checks(payloads: DataFrame, registry: DataFrame, limit: int = 250 * 1024) -> DataFrame:
    """(payload_id, check, passed): for each of payloads(payload_id, body) whether registry(secret) stands in it as it is, normalized, or encoded, by family; and its size."""
    norm = registry.select(T.normalize_any()(F.col("secret")).alias("secret"))
    as_is = norm.select(F.col("secret").alias("pattern"), F.lit("raw").alias("check"))
    coded = norm.select(F.explode(T.encodings(F.col("secret"))).alias("pattern")).withColumn("check", form_family(F.col("pattern"))).where("check IS NOT NULL")
    forms = as_is.unionByName(coded)
    found = contain.holding(payloads, forms.select("pattern").distinct(), "payload_id", "body").join(forms, "pattern").select("payload_id", "check")
    lower = payloads.select("payload_id", T.normalize_any()(F.col("body")).alias("body"))
    also = contain.holding(lower, as_is.select("pattern").distinct(), "payload_id", "body").select("payload_id", F.lit("normalized").alias("check"))
    failed = found.unionByName(also).distinct().withColumn("failed", F.lit(True))
    every = payloads.select("payload_id", F.explode(F.array(*map(F.lit, AUDIT_CHECKS))).alias("check")).join(failed, ["payload_id", "check"], "left")
    size = payloads.select("payload_id", F.lit("payload_size").alias("check"), (F.length("body") <= limit).alias("passed"))
    return every.select("payload_id", "check", F.col("failed").isNull().alias("passed")).unionByName(size)


def canaries(wire: DataFrame, known: DataFrame) -> DataFrame:
    """(request_id, type, canary, encoding) of wire(request_id, run, body) and known(run, type, value): values of six characters or more that left, by the first form that is found, else, from
    ten characters on, by three runs of eight characters or more that are shared."""
    nfkc = T.normalize_any()
    value = known.select("run", "type", nfkc(F.col("value")).alias("canary")).where(F.length("canary") >= 6).distinct()
    forms = value.select("run", "type", "canary", F.posexplode(F.concat(F.array("canary"), T.encodings(F.col("canary")))).alias("nth", "pattern")).where(F.length("pattern") >= 6)
    text = wire.select("request_id", "run", nfkc(F.col("body")).alias("body")).withColumn("__row", F.struct("request_id", "run"))
    same = lambda a, b, on: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on])
    # a form is looked for once, whatever runs know it
    met = contain.holding(text, forms.select("pattern"), "__row", "body", least=contain.SEED).select("__row.*", "pattern").alias("m")
    hit = met.join(forms.alias("f"), same("m", "f", ("run", "pattern"))).groupBy("m.request_id", "m.run", "f.type", "f.canary").agg(F.min("f.nth").alias("nth"))
    whole = hit.select("request_id", "run", "type", "canary", F.when(F.col("nth") == 0, "raw").otherwise(F.concat(F.lit("enc"), (F.col("nth") - 1).cast("string"))).alias("encoding"))
    shared = contain.shared_grams(text, value.where(F.length("canary") >= 10).select("canary").distinct(), "__row", "body", "canary", GRAM).where("n_shared >= 3").select("__row.*", F.col("secret").alias("canary")).alias("t")
    near = shared.join(value.alias("p"), same("t", "p", ("run", "canary"))).select("t.request_id", "t.run", "p.type", "p.canary")
    part = near.join(whole.select("request_id", "type", "canary"), ["request_id", "type", "canary"], "left_anti").withColumn("encoding", F.lit("8-gram"))
    return whole.unionByName(part).select("request_id", "run", "type", "canary", "encoding")


def detection(wire: DataFrame, shown: DataFrame) -> DataFrame:
    """(run, tp, fn, fp, recall, precision) of wire(run, body) and shown(run, at, value, decoy): a value is kept back if it is not on the wire in any form; a decoy that isn't there was
    taken for a value. A value shown several times is what it was last."""
    nfkc = T.normalize_any()
    last = shown.groupBy("run", "value").agg(F.max_by("decoy", "at").alias("decoy")).withColumn("norm", nfkc(F.col("value")))
    forms = last.where(F.length("norm") >= 4).select("run", "value", F.explode(F.concat(F.array("norm"), F.filter(T.encodings(F.col("norm")), lambda f: F.length(f) >= 8))).alias("pattern"))
    bodies = wire.select("run", nfkc(F.col("body")).alias("text"))
    met = contain.holding(bodies, forms.select("pattern"), "run", least=4)
    hit = met.alias("m").join(forms.alias("f"), F.col("m.run").eqNullSafe(F.col("f.run")) & (F.col("m.pattern") == F.col("f.pattern"))).select("f.run", "f.value").distinct().withColumn("leaked", F.lit(True))
    both = last.alias("l").join(hit.alias("h"), F.col("l.run").eqNullSafe(F.col("h.run")) & (F.col("l.value") == F.col("h.value")), "left").select("l.run", "l.decoy", F.coalesce("h.leaked", F.lit(False)).alias("leaked"))
    per = both.groupBy("run").agg(F.count_if(~F.col("decoy") & ~F.col("leaked")).alias("tp"), F.count_if(~F.col("decoy") & F.col("leaked")).alias("fn"), F.count_if(F.col("decoy") & ~F.col("leaked")).alias("fp"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return per.select("*", share("tp", "fn").alias("recall"), share("tp", "fp").alias("precision"))


def registry_scan(strings: DataFrame, registry: DataFrame, fragments: bool = True) -> DataFrame:
    """Violations of strings(payload_id, value) that hold a secret of registry(secret, or secret and tier) in any encoding, or any run of GRAM characters of a secret of tier 1 or 2. Secrets without a tier count as such. fragments=False: whole secrets only."""
    normal = registry.select("secret", T.normalize_any()(F.col("secret")).alias("norm"))
    forms = normal.select(F.explode(F.array_union(F.array("secret", "norm"), F.array_union(T.encodings(F.col("secret")), T.encodings(F.col("norm"))))).alias("pattern"))
    texts = strings.select("payload_id", T.normalize_any()(F.regexp_replace("value", "⟦[A-Z_]+(?:#[0-9]+)?⟧", " ")).alias("text"))
    found = contain.holding(texts, forms, "payload_id", least=contain.SEED).select("payload_id")
    if fragments:
        secrets = registry.where(F.coalesce(F.col("tier"), F.lit(1)) <= 2) if "tier" in registry.columns else registry
        found = found.unionByName(contain.shared_grams(texts, secrets.select(T.normalize_any()(F.col("secret")).alias("secret")).distinct(), "payload_id", n=GRAM).select("payload_id"))
    return violation(found, "REGISTRY_SCAN")


def sweep(strings: DataFrame, names=tuple(recognize.RECOGNIZERS)) -> DataFrame:
    """Violations of strings that a recognizer of tier 1 or 2 finds something in."""
    shaped = (F.length("value") >= 6) & (F.col("value").rlike("[0-9@]") | ((F.length("value") >= 16) & F.col("value").rlike("[_-]")))
    hit = F.exists(recognize.recognize(F.col("value"), names), lambda s: s["tier"] <= 2)
    return violation(strings.where(shaped & ~F.col("value").rlike(r"^⟦[A-Z_]+(#[0-9]+)?⟧$")).where(hit), "TYPE_BRAND")


def entropy(strings: DataFrame) -> DataFrame:
    """Violations of strings without white space or handles, parted at slashes, with a long part of many bits a character."""
    whole = strings.where(~F.col("value").rlike(rf"{T.SPACE}|⟦|^https?://"))
    parts = whole.select("payload_id", F.explode(F.split("value", "/")).alias("part")).where(F.length("part") >= schema.ENTROPY_LENGTH)
    return violation(parts.where(F.round(checks.shannon(F.col("part")), 9) > schema.ENTROPY_BITS), "ENTROPY_HEURISTIC")


def size(payloads: DataFrame, limit: int = schema.MAX_PAYLOAD_BYTES) -> DataFrame:
    return violation(payloads.where(F.octet_length("body") > limit), "SIZE_BUDGET")


def origin(url: Column) -> Column:
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("AUTHORITY")))


def destination(payloads: DataFrame, allowed: str) -> DataFrame:
    return violation(payloads.where(~F.coalesce(origin(F.col("destination")) == allowed, F.lit(False))), "DESTINATION_PIN")


def verdicts(payloads: DataFrame, *violations: DataFrame) -> DataFrame:
    """(payload_id, code): the first violation in ORDER, null for what may leave."""
    first = reduce(DataFrame.unionByName, violations).groupBy("payload_id").agg(F.min(F.struct("seq", "code"))["code"].alias("code"))
    return payloads.select("payload_id").join(first, "payload_id", "left")


def payload_scan(payload: Column, value: Column, least: int = 4) -> Column:
    """array<struct<encoder, found>>: is the value in the payload as it is or in one of its encodings?"""
    low = F.lower(payload)
    forms = T.encodings(value)
    return F.transform(forms, lambda f: F.struct(f.alias("form"), (F.length(f) >= least).alias("long"), F.contains(low, f).alias("found")))


def literal_scan(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(payload_id, secret) of texts(payload_id, value) that hold a secret in any encoding or over 70 % of its runs of eight characters."""
    nfkc = T.normalize_any()
    norm = texts.select("payload_id", nfkc(F.col("value")).alias("text"))
    normal = registry.select("secret", nfkc(F.col("secret")).alias("norm"))
    forms = normal.select("secret", F.explode(F.array_union(F.array("secret", "norm"), F.array_union(T.encodings(F.col("secret")), T.encodings(F.col("norm"))))).alias("pattern"))
    whole = contain.holding(norm, forms, "payload_id", least=contain.SEED).join(forms, "pattern").select("payload_id", "secret")
    near = contain.shared_grams(norm, normal.select(F.col("norm").alias("secret")).distinct(), "payload_id").where("n_shared > 0.7 * n_grams")
    part = near.select("payload_id", F.col("secret").alias("norm")).join(normal, "norm").select("payload_id", "secret")
    return whole.unionByName(part).distinct()


def handle_consistency(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(handle, problem) of used(handle) and declared(handle, type): dangling, unreferenced, or of several types."""
    has = lambda df, p: df.select("handle", F.lit(p).alias("problem")).distinct()
    several = declared.groupBy("handle").agg(F.countDistinct("type").alias("n")).where("n > 1")
    return has(used.join(declared, "handle", "left_anti"), "dangling").unionByName(has(declared.join(used, "handle", "left_anti"), "unreferenced")).unionByName(has(several, "ambiguous"))


def leakage(released: DataFrame, truth: DataFrame) -> DataFrame:
    """(run, n, leaked, tier1) of truth(run, value, tier): how many values stand, normalized, in released(run, body). Values under four characters are noise and don't count."""
    nfkc = T.normalize_any()
    values = truth.select("run", nfkc(F.col("value")).alias("pattern"), "tier").where(F.length("pattern") >= 4).distinct()
    bodies = released.select("run", nfkc(F.col("body")).alias("text"))
    found = contain.holding(bodies, values, "run", least=4).withColumn("hit", F.lit(True))
    same = F.col("v.run").eqNullSafe(F.col("f.run")) & (F.col("v.pattern") == F.col("f.pattern"))
    out = values.alias("v").join(found.alias("f"), same, "left").select("v.*", "f.hit")
    return out.groupBy("run").agg(F.count("*").alias("n"), F.count_if("hit").alias("leaked"), F.count_if(F.col("hit") & (F.col("tier") == 1)).alias("tier1"))


def mlp(x: Column, w1, b1, w2, b2) -> Column:
    """A dense layer with ReLU and a linear one on an array of numbers; weights are lists of rows."""
    dot = lambda a, row: F.aggregate(F.zip_with(a, F.array(*map(F.lit, row)), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    hidden = F.array(*[F.greatest(F.lit(0.0), dot(x, row) + b) for row, b in zip(w1, b1, strict=True)])
    return T.let(hidden, lambda h: F.array(*[dot(h, row) + b for row, b in zip(w2, b2, strict=True)]))
