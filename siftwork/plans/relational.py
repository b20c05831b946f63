"""Queries of the relational operators over the driver's tables, and their SQL twins.

Rectangles come from lineitem: a page is sixteen orders, a line item a rectangle whose place and size follow from its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from siftwork import schema
from siftwork.functions import checks, text as T
from siftwork.operators import contain, fusion, geometry as G, intervals, metrics, recognize, session, sessions
from siftwork.plans.probes import RULES, _ENTROPY, found_sql, q

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- rectangles
def rects(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """once: without repeated rows, which some readers don't mind."""
    li = read(spark, sf_dir, "lineitem")
    ident = (F.col("l_orderkey") * 1000 + F.pmod("l_partkey", F.lit(100)) * 10 + F.col("l_linenumber")).cast("long")
    r = li.select(F.floor(F.col("l_orderkey") / 16).alias("obs"), ident.alias("id"), F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 91, F.lit(1280)).alias("x"), F.pmod(F.col("l_linenumber") * 97 + F.pmod("l_partkey", F.lit(100)) * 7, F.lit(900)).alias("y"), (8 + F.pmod(F.col("l_orderkey"), F.lit(120))).alias("w"), (8 + F.pmod("l_partkey", F.lit(100)) % 40).alias("h"))
    r = r.distinct() if once else r
    return r.select("obs", "id", G.rect("x", "y", "w", "h").alias("rect"), F.pmod("id", F.lit(2)).alias("side"))


R = """r AS (SELECT DISTINCT (l_orderkey // 16)::BIGINT AS obs, (l_orderkey * 1000 + l_partkey % 100 * 10 + l_linenumber)::BIGINT AS id, ((l_orderkey * 37 + l_linenumber * 91) % 1280)::DOUBLE AS x,
  ((l_linenumber * 97 + l_partkey % 100 * 7) % 900)::DOUBLE AS y, (8 + l_orderkey % 120)::DOUBLE AS w, (8 + l_partkey % 100 % 40)::DOUBLE AS h FROM lineitem)"""
_MEET = "a.x < b.x + b.w AND a.x + a.w > b.x AND a.y < b.y + b.h AND a.y + a.h > b.y"
_BOTH = "(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _pairs(spark, sf_dir):
    r = rects(spark, sf_dir)
    return r.where("side = 0").drop("side"), r.where("side = 1").drop("side").withColumnRenamed("id", "other")


@query(f"WITH {R} SELECT a.obs, a.id, b.id AS other FROM r a JOIN r b ON a.obs = b.obs AND a.id % 2 = 0 AND b.id % 2 = 1 AND {_MEET}")
def spatial_index(spark, sf_dir):
    left, right = _pairs(spark, sf_dir)
    return G.overlap_join(left, right, "obs", "id", "other").select("obs", "id", "other")


@query(f"""WITH {R} SELECT a.obs, a.id, b.id AS other, round({_BOTH} / (a.w * a.h + b.w * b.h - {_BOTH}), 6) AS iou, {_BOTH} AS common, (greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x)) * (greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)) AS box,
  a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h AS inside, b.x + b.w / 2 BETWEEN a.x AND a.x + a.w AND b.y + b.h / 2 BETWEEN a.y AND a.y + a.h AS centred, round({_BOTH} / (a.w * a.h), 6) AS share
FROM r a JOIN r b ON a.obs = b.obs AND a.id % 2 = 0 AND b.id % 2 = 1 AND {_MEET}""")
def geo_algebra(spark, sf_dir):
    left, right = _pairs(spark, sf_dir)
    a, b = F.col("l"), F.col("r")
    met = G.overlap_join(left, right, "obs", "id", "other")
    return met.select("obs", "id", "other", F.round(G.iou(a, b), 6).alias("iou"), G.area(G.intersect(a, b)).alias("common"), G.area(G.union(a, b)).alias("box"), G.contains(a, b).alias("inside"), G.point_in(a, b["x"] + b["w"] / 2, b["y"] + b["h"] / 2).alias("centred"), F.round(G.overlap_fraction(a, b), 6).alias("share"))


@query(f"WITH {R} SELECT obs, id, floor((x - 640.5) / 4 + 0.5) * 4 AS qx, floor(y / 4 + 0.5) * 4 AS qy, floor(w * 1.5 / 4 + 0.5) * 4 AS qw, floor(h * 0.5 / 4 + 0.5) * 4 AS qh, (w + 6) * (h + 6) AS grown FROM r")
def geo_quantize(spark, sf_dir):
    r = F.col("rect")
    s = G.scale(r, 1.5, 0.5)
    return rects(spark, sf_dir).select("obs", "id", G.quantize(r["x"] - 640.5).alias("qx"), G.quantize(r["y"]).alias("qy"), G.quantize(s["w"]).alias("qw"), G.quantize(s["h"]).alias("qh"), G.area(G.expand(r, 3)).alias("grown"))


def _union_sql(source: str, key: str) -> str:
    """Covered area by key over source(key, x, y, w, h)."""
    return f"""xs AS (SELECT {key}, v, lead(v) OVER (PARTITION BY {key} ORDER BY v) AS n FROM (SELECT {key}, x AS v FROM {source} UNION SELECT {key}, x + w FROM {source})),
ys AS (SELECT {key}, v, lead(v) OVER (PARTITION BY {key} ORDER BY v) AS n FROM (SELECT {key}, y AS v FROM {source} UNION SELECT {key}, y + h FROM {source})),
areas AS (SELECT xs.{key}, sum((xs.n - xs.v) * (ys.n - ys.v)) AS area FROM xs JOIN ys ON xs.{key} = ys.{key} AND xs.n IS NOT NULL AND ys.n IS NOT NULL
  WHERE EXISTS (SELECT 1 FROM {source} s WHERE s.{key} = xs.{key} AND s.x <= xs.v AND s.x + s.w >= xs.n AND s.y <= ys.v AND s.y + s.h >= ys.n) GROUP BY xs.{key})"""


@query(f"WITH {R}, o AS (SELECT id // 1000 AS page, x, y, w, h FROM r), {_union_sql('o', 'page')} SELECT page, area FROM areas")
def geo_area_union(spark, sf_dir):
    per = rects(spark, sf_dir).groupBy(F.floor(F.col("id") / 1000).alias("page")).agg(F.collect_list("rect").alias("rects"))
    return per.select("page", G.area_union(F.col("rects")).alias("area"))


_COVER = f"""WITH {R}, m AS (SELECT a.obs, a.id, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS h,
  row_number() OVER (PARTITION BY a.obs, a.id ORDER BY {_BOTH} DESC, b.id) AS nth FROM r a JOIN r b ON a.obs = b.obs AND a.id % 2 = 0 AND b.id % 2 = 1 AND {_MEET}),
c AS (SELECT * FROM m WHERE nth <= {fusion.OWNERS}), {_union_sql('c', 'id')}, s AS (SELECT r.obs, r.id, round(least(1, coalesce(area, 0) / (r.w * r.h)), 6) AS coverage FROM r LEFT JOIN areas ON r.id = areas.id WHERE r.id % 2 = 0)"""


@query(f"{_COVER} SELECT * FROM s")
def coverage_fraction(spark, sf_dir):
    left, right = _pairs(spark, sf_dir)
    return fusion.coverage(left, right.withColumnRenamed("other", "eid")).select("obs", "id", F.round("coverage", 6).alias("coverage"))


@query(f"{_COVER} SELECT obs, id, CASE WHEN coverage = 0 THEN 'opaque, no DOM owner' ELSE 'opaque, only some' END AS reason FROM s WHERE coverage < 0.9")
def explain_or_redact(spark, sf_dir):
    left, right = _pairs(spark, sf_dir)
    out = fusion.explain_or_redact(left.withColumn("reason", F.lit("opaque")), right.withColumnRenamed("other", "eid"), 0.9)
    return out.select("obs", "id", F.regexp_replace("reason", "only [0-9]+% owned by the DOM", "only some").alias("reason"))


_KINDS = ("regex", "ner", "ocr", "vision", "deterministic")
_TYPES = ("EMAIL", "PERSON_NAME", "PASSWORD", "CITY", "PAN")


def _evidence(spark, sf_dir):
    r = rects(spark, sf_dir)
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), F.pmod(by, F.lit(len(names))).cast("int"))
    seen = r.where("side = 0").select("obs", F.col("id").alias("ord"), pick(_KINDS, F.floor(F.col("id") / 10)).alias("type"), pick(_TYPES, F.floor(F.col("id") / 1000)).alias("pii_type"), (F.pmod("id", F.lit(89)) / 210).alias("confidence"), "rect")
    odd = r.where("side = 1 AND pmod(id, 3) = 0").select("obs", F.col("id").alias("ord"), "rect", F.lit("opaque").alias("reason"))
    return seen, odd


def _pick(names, by):
    return f"([{', '.join(map(q, names))}])[({by}) % {len(names)} + 1]"


_B = schema.PROFILES["BALANCED"]
_FUSE = f"""WITH {R}, d AS (SELECT obs, id AS ord, x, y, w, h, {_pick(_KINDS, 'id // 10')} AS type, {_pick(_TYPES, 'id // 1000')} AS pii_type, id % 89 / 210 AS confidence FROM r WHERE id % 2 = 0),
e AS (SELECT *, confidence * CASE type {' '.join(f"WHEN '{k}' THEN {_B[k]}" for k in _KINDS)} END AS term FROM d),
n AS (SELECT obs, x, y, w, h, 0 AS odd FROM d UNION ALL SELECT obs, x, y, w, h, 1 FROM r WHERE id % 2 = 1 AND id % 3 = 0),
a AS (SELECT obs, floor(x / 8) * 8 AS x, floor(y / 8) * 8 AS y, ceil(w / 8) * 8 AS w, ceil(h / 8) * 8 AS h, max(odd) AS odd FROM n GROUP BY ALL),
s AS (SELECT a.obs, a.x, a.y, a.w, a.h, a.odd, count(b.ord)::BIGINT AS n_evidence, round(1 - coalesce(product(1 - b.term), 1) * CASE WHEN a.odd = 1 THEN 1 - {_B['unexplained_prior']} ELSE 1 END, 6) AS sensitivity, coalesce(bool_or(b.pii_type = 'PASSWORD'), false) AS holds
  FROM a LEFT JOIN e b ON a.obs = b.obs AND {_MEET} GROUP BY a.obs, a.x, a.y, a.w, a.h, a.odd)
SELECT obs, x, y, w, h, n_evidence, sensitivity, CASE WHEN holds THEN 'VAULT_ONLY' WHEN sensitivity >= 0.8 THEN 'DROP' WHEN sensitivity >= 0.5 THEN 'MASK' WHEN sensitivity >= 0.35 THEN 'TOKENIZE' ELSE 'PASS' END AS action FROM s WHERE n_evidence > 0 OR odd = 1"""


@query(_FUSE)
def fuse_regions(spark, sf_dir):
    out = fusion.fuse(*_evidence(spark, sf_dir), "BALANCED")
    s = F.round("sensitivity", 6)
    # thresholds apply to the rounded score on both sides, so that the last bit doesn't decide
    action = F.when(F.col("action") == "VAULT_ONLY", "VAULT_ONLY").otherwise(fusion.decide("BALANCED", s, F.lit(None).cast("int")))
    return out.select("obs", "rect.x", "rect.y", "rect.w", "rect.h", F.col("n_evidence").cast("long").alias("n_evidence"), s.alias("sensitivity"), action.alias("action"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*)::BIGINT AS n, CASE WHEN l_linenumber = 1 THEN 'VAULT_ONLY' WHEN l_discount * 10 >= 0.8 THEN 'DROP' WHEN l_discount * 10 >= 0.5 THEN 'MASK' WHEN l_discount * 10 >= 0.35 THEN 'TOKENIZE'
  WHEN l_linenumber = 2 THEN 'TOKENIZE' WHEN l_linenumber = 3 THEN 'TOKENIZE' WHEN l_linenumber = 5 THEN 'TOKENIZE' ELSE 'PASS' END AS strict FROM lineitem GROUP BY ALL""")
def policy_decide(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber"))
    return li.groupBy("l_orderkey", "l_linenumber", "l_partkey", fusion.decide("STRICT", F.col("l_discount") * 10, tier).alias("strict")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, round(1 - product(1 - least(l_discount * 20 / 7, 1)), 6) AS score FROM lineitem GROUP BY 1""")
def noisy_or(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_discount") * 20 / 7)).alias("t"))
    return per.select("l_orderkey", F.round(fusion.noisy_or(F.col("t")), 6).alias("score"))


@query(f"WITH {R} SELECT obs, id, row_number() OVER (PARTITION BY obs ORDER BY w * h DESC, id % 7 DESC, id) <= 6 AS taken FROM r")
def crop_topk(spark, sf_dir):
    return fusion.top_crops(rects(spark, sf_dir).select("obs", "id", "rect", F.pmod("id", F.lit(7)).alias("suspicion"))).select("obs", "id", "taken")


# ---- values of a session
#: All recognizers that the twins' engine can say: fifteen of sixteen.
_NAMES = tuple(RULES)
_VALUES = f"""WITH probe AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(map(found_sql, _NAMES))},
v AS (SELECT source AS session, e.doc_id * 1000000 + "start" AS ord, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS key, type, tier FROM ({" UNION ALL ".join(f"SELECT * FROM {n}" for n in _NAMES)}) e JOIN documents USING (doc_id)),
f AS (SELECT session, key, min(ord) AS first_ord, arg_min(type, (ord, type, tier)) AS kind, arg_min(tier, (ord, type, tier))::INTEGER AS tier FROM v GROUP BY ALL),
t AS (SELECT session, key, kind, tier, first_ord, row_number() OVER (PARTITION BY session ORDER BY first_ord, key)::INTEGER AS index FROM f)"""


def _values(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("source", "doc_id", F.explode(recognize.recognize(F.col("text"), _NAMES)).alias("s"))
    return found.select(F.col("source").alias("session"), (F.col("doc_id") * 1000000 + F.col("s.start")).alias("ord"), F.col("s.value").alias("value"), F.col("s.type").alias("type"), F.col("s.tier").alias("tier"))


@query(f"{_VALUES} SELECT session, key, kind, tier, index, CASE WHEN tier = 1 THEN '⟦' || kind || '⟧' ELSE '⟦' || kind || '#' || index || '⟧' END AS handle FROM t")
def tokenize(spark, sf_dir):
    return session.numbered(_values(spark, sf_dir)).select("session", "key", "kind", "tier", "index", "handle")


@query(f"""{_VALUES}, h AS (SELECT *, CASE WHEN kind = 'CARD' OR tier = 1 THEN '⟦' || kind || '⟧' ELSE '⟦' || kind || '#' || index || '⟧' END AS handle FROM t)
SELECT session, key, handle FROM (SELECT *, row_number() OVER (PARTITION BY session, handle ORDER BY first_ord, key) AS nth FROM h) WHERE nth = 1""")
def tokenize_register(spark, sf_dir):
    """Cards as secrets of the first tier: only the first of a session is registered, as of other secrets."""
    values = _values(spark, sf_dir).withColumn("tier", F.when(F.col("type") == "CARD", 1).otherwise(F.col("tier")))
    return session.register(values).select("session", "key", "handle")


@query()
def substitute(spark, sf_dir):
    """Documents with all values known of their own source that they hold replaced by handles, recognized in them or not."""
    handles = session.numbered(_values(spark, sf_dir))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    out = session.substitute_known(docs.withColumnRenamed("source", "session"), "text", handles, ["doc_id"])
    return out.select("doc_id", "text")


@query(f"{_VALUES} SELECT kind AS type, min(tier)::INTEGER AS tier, count(*)::BIGINT AS n, sum(c)::BIGINT AS occurrences FROM t JOIN (SELECT session, key, count(*) AS c FROM v GROUP BY ALL) USING (session, key) GROUP BY 1")
def handle_summary(spark, sf_dir):
    values = _values(spark, sf_dir)
    times = values.withColumn("key", T.normalize_any()(F.col("value"))).groupBy("session", "key").agg(F.count("*").alias("occurrences"))
    return session.summarize(session.numbered(values).select("session", "key", F.col("kind").alias("type"), "tier").join(times, ["session", "key"]))


# ---- text functions
@query("SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text, regexp_replace(text, '[\\s.-]', '', 'g') AS plain FROM conversations")
def normalize(spark, sf_dir):
    """All turns. The twin has no NFKC, which changes nothing in these texts (tests/test_operators.py has some that it changes)."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", T.normalize_any()(F.col("text")).alias("text"), T.normalize_numeric(F.col("text")).alias("plain"))


@query()
def normalize_whole(spark, sf_dir):
    """normalize over all turns, behind NFKC, which SQL doesn't have."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", T.normalize_any()(F.col("text")).alias("text"), T.normalize_numeric(F.col("text")).alias("plain"))


_ESC = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


@query(f"""SELECT page_id, list_distinct(list_transform([url, {_ESC.format('url')}, {_ESC.format(_ESC.format('url'))}, base64(encode(url)), replace(translate(base64(encode(url)), '+/', '-_'), '=', ''), hex(encode(url)),
  list_reduce(list_transform(string_split(url, ''), lambda c: '&#' || ascii(c) || ';'), lambda a, b: a || b), replace(replace(url, '''', '&apos;'), '/', '&#x2F;'), list_reduce(list_transform(string_split(url, ''), lambda c: chr(92) || chr(92) || 'u' || lpad(hex(ascii(c)), 4, '0')), lambda a, b: a || b)], lambda f: lower(f))).list_sort().array_to_string(' ') AS forms FROM pages""")
def encodings(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(T.encodings(F.col("url"))), " ").alias("forms"))


@query("""SELECT item_id, greatest(length(text) - 7, 0)::BIGINT AS n, len(list_distinct(list_transform(range(1, greatest(length(text) - 6, 1)), lambda i: substr(text, i, 8))))::BIGINT AS n_distinct FROM benchmark""")
def ngrams(spark, sf_dir):
    g = T.grams(F.col("text"), 8)
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


_GRAMS = """i AS (SELECT item_id, length(text) AS n, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 22, 1)), lambda i: substr(text, i, 24)))) AS g FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 22, 1)), lambda i: substr(text, i, 24)))) AS g FROM documents)"""


@query(f"WITH {_GRAMS} SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM d JOIN i USING (g) GROUP BY ALL")
def ngram_matches(spark, sf_dir):
    """Runs of 24 characters that documents share with benchmark items."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("secret"))
    found = contain.shared_grams(read(spark, sf_dir, "documents").select("doc_id", "text"), items, "doc_id", n=24)
    return found.join(items, "secret").select("doc_id", "item_id", "n_shared")


@query(f"WITH {_GRAMS} SELECT DISTINCT doc_id FROM d JOIN i USING (g)")
def ngram_overlap(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.col("text").alias("secret"))
    return contain.shared_grams(read(spark, sf_dir, "documents").select("doc_id", "text"), items, "doc_id", n=24).select("doc_id").distinct()


_GRAMS_8 = _GRAMS.replace("length(text) - 22", "length(text) - 6").replace("substr(text, i, 24)", "substr(text, i, 8)")


@query(f"WITH {_GRAMS_8} SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM d JOIN i USING (g) GROUP BY ALL")
def ngram_matches_8(spark, sf_dir):
    """ngram_matches at the n of the gate."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("secret"))
    found = contain.shared_grams(read(spark, sf_dir, "documents").select("doc_id", "text"), items.select("secret").distinct(), "doc_id")
    return found.join(items, "secret").select("doc_id", "item_id", "n_shared")


@query(f"WITH {_GRAMS_8}, o AS (SELECT DISTINCT g FROM i) SELECT DISTINCT doc_id FROM d SEMI JOIN o USING (g)")
def ngram_overlap_8(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(T.grams(F.col("text"), 8))).alias("g")).distinct()
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.grams(F.col("text"), 8))).alias("g"))
    return docs.join(items, "g", "left_semi").select("doc_id").distinct()


@query("""WITH p AS (SELECT DISTINCT w AS pattern FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{11,}')) AS w FROM benchmark)) SELECT doc_id, pattern, (strpos(text, pattern) - 1)::BIGINT AS first_start FROM documents JOIN p ON contains(text, pattern)""")
def ac_search(spark, sf_dir):
    """Long words of the benchmark in documents: the first place of each."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{11,}"), F.lit(0))).alias("pattern")).distinct()
    found = contain.search(read(spark, sf_dir, "documents").select("doc_id", "text"), words, "doc_id")
    return found.groupBy("doc_id", "pattern").agg(F.min("start").cast("long").alias("first_start"))


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_-]{{16,}}')) AS value FROM documents) SELECT value, round({_ENTROPY}, 6) AS bits FROM w")
def shannon(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]{16,}"), F.lit(0))).alias("value")).distinct()
    return words.select("value", F.round(checks.shannon(F.col("value")), 6).alias("bits"))


@query(f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r]+')) AS value FROM documents) SELECT doc_id, count(*)::BIGINT AS n FROM w WHERE length(value) >= {schema.ENTROPY_LENGTH} AND round({_ENTROPY}, 9) > {schema.ENTROPY_BITS} AND NOT regexp_matches(value, '^https?://') GROUP BY 1")
def gate_entropy(spark, sf_dir):
    """Words of documents that look like keys."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\x0c\r]+"), F.lit(0))).alias("v")).where(F.length("v") >= schema.ENTROPY_LENGTH)
    return words.where((F.round(checks.shannon(F.col("v")), 9) > schema.ENTROPY_BITS) & ~F.col("v").rlike("^https?://")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT), 36)) AS hash FROM pages")
def fnv1a(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", checks.fnv1a(F.col("url")).alias("hash"))


_SEGMENT = " OR ".join(f"regexp_matches(s, {q(p)})" for p in schema.ID_SEGMENTS) + " OR (" + " AND ".join(f"regexp_matches(s, {q(p)})" for p in schema.ID_MIXED) + ")"


@query(f"SELECT page_id, array_to_string(list_transform(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: CASE WHEN {_SEGMENT} THEN '{{id}}' ELSE s END), '/') AS template, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) = 'http://tionsh.example.net' AS pinned FROM pages")
def url_template(spark, sf_dir):
    """Paths with identifiers taken out, and whether the page is of one origin."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    is_id = lambda s: F.coalesce(*[F.when(s.rlike(p), True) for p in schema.ID_SEGMENTS], s.rlike(schema.ID_MIXED[0]) & s.rlike(schema.ID_MIXED[1]))
    made = F.array_join(F.transform(F.split(path, "/", -1), lambda s: F.when(is_id(s), "{id}").otherwise(s)), "/")
    origin = F.concat(F.parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.parse_url("url", F.lit("AUTHORITY")))
    return read(spark, sf_dir, "pages").select("page_id", made.alias("template"), (origin == "http://tionsh.example.net").alias("pinned"))


@query("SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text))) > 2000 AS too_large FROM conversations GROUP BY 1")
def gate_size(spark, sf_dir):
    per = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return per.select("conv_id", "bytes", (F.col("bytes") > 2000).alias("too_large"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::BIGINT AS distance, round(levenshtein(a.p_name, b.p_name) / length(b.p_name), 6) AS cer FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def levenshtein_cer(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "b").cast("long").alias("distance"), F.round(metrics.cer(F.col("p_name"), F.col("b")), 6).alias("cer"))


# ---- intervals
_WORDS = r"""m AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS m FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) AS i, len(m) AS n FROM m),
o AS (SELECT doc_id, i, n, sum(length(w)) OVER p - length(ltrim(w, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s, sum(length(w)) OVER p AS e FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i))"""


@query(f"""WITH {_WORDS}, k AS (SELECT a.doc_id, (a.i - 1) // 448 AS nth, a.s, least(a.i + 511, a.n) AS last, a.n FROM o a WHERE a.n > 512 AND (a.i - 1) % 448 = 0 AND (a.i = 1 OR a.i - 448 + 512 <= a.n))
SELECT k.doc_id, k.nth::BIGINT AS nth, k.s::BIGINT AS "offset", (o.e - k.s)::BIGINT AS width FROM k JOIN o ON o.doc_id = k.doc_id AND o.i = k.last
UNION ALL SELECT doc_id, 0, 0, length(text)::BIGINT FROM m WHERE len(m) BETWEEN 1 AND 512""")
def chunk_text(spark, sf_dir):
    out = intervals.chunk_text(read(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return out.select("doc_id", "nth", "offset", F.length("text").cast("long").alias("width"))


_NODES = """n AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), p AS (SELECT conv_id, turn, length(t) AS len, coalesce(sum(length(t)) OVER b, 0) AS wrote, coalesce(max((length(t) > 0)::INT) OVER b, 0) AS opened FROM n WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT conv_id, turn, (wrote + sum(opened) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS s, len FROM p)"""


@query(f'WITH {_NODES} SELECT conv_id, turn, s AS "start", (s + len)::BIGINT AS "end" FROM j')
def join_nodes(spark, sf_dir):
    return intervals.join_nodes(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"""WITH {_NODES}, r AS (SELECT conv_id, turn, s AS r0, s + len AS r1 FROM j), t AS (SELECT conv_id, max(r1) AS n FROM r GROUP BY 1), x AS (SELECT conv_id, unnest(range(0, n, 70)) AS s0 FROM t)
SELECT r.conv_id, turn, s0 AS s_start, greatest(s0, r0) - r0 AS "start", least(s0 + 40, r1) - r0 AS "end" FROM x JOIN r ON r.conv_id = x.conv_id AND s0 < r1 AND s0 + 40 > r0 WHERE greatest(s0, r0) < least(s0 + 40, r1)""")
def map_spans(spark, sf_dir):
    """A span of 40 characters every 70 of each joined conversation, back in its turns."""
    ranges = intervals.join_nodes(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    whole = ranges.groupBy("conv_id").agg(F.max("end").alias("n")).where("n > 0")
    spans = whole.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(70).cast("long"))).alias("start")).withColumn("end", F.col("start") + 40)
    return intervals.map_spans(spans, ranges, "conv_id", "turn")


# ---- events of a session
@query("SELECT event_id, event_type = lag(event_type) OVER w AND event_type = lag(event_type, 2) OVER w IS TRUE AS looped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("event_type = lag(event_type) OVER w AND event_type = lag(event_type, 2) OVER w IS TRUE", "coalesce(event_type = lag(event_type) OVER w, false) AND coalesce(event_type = lag(event_type, 2) OVER w, false)"))
def loop_detector(spark, sf_dir):
    return sessions.loops(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "looped")


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i""")
def failure_streak(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return sessions.streaks(rows, "user_id", ["ts", "event_id"], "failed").select("event_id", "streak")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stability(spark, sf_dir):
    return sessions.quiet(read(spark, sf_dir, "events"), "user_id", "ts", "30 minutes").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query()
def gate_rate(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    return sessions.rate_limit(rows, "user_id", "ms", "event_id", window=3_600_000, most=2)


# ---- scores
@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN NULL ELSE l_returnflag END AS type, count(*)::BIGINT AS total, count(*) FILTER (l_quantity > 25)::BIGINT AS false_positives, round(count(*) FILTER (l_quantity > 25) / count(*), 6) AS rate FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def near_miss_fpr(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_quantity") > 25).alias("flagged"))
    return metrics.near_misses(rows).withColumn("rate", F.round("rate", 6))


@query("""WITH c AS (SELECT lang AS type, (n_chars > 1000 AND quality = 1)::INT AS tp, (n_chars > 1000 AND quality = 0)::INT AS fp, (n_chars <= 1000 AND quality = 1)::INT AS fn FROM labels JOIN documents USING (doc_id)),
s AS (SELECT type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (type)), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM s)
SELECT type, tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r""")
def prf_by_type(spark, sf_dir):
    """A length rule judged against the quality labels, by language and over all."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    is_long, good = F.col("n_chars") > 1000, F.col("quality") == 1
    counts = rows.select(F.col("lang").alias("type"), (is_long & good).cast("long").alias("tp"), (is_long & ~good).cast("long").alias("fp"), (~is_long & good).cast("long").alias("fn"))
    return metrics.prf(counts).select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[least(len(v) - 1, floor(len(v) * 0.5)::INT) + 1] AS p50, v[least(len(v) - 1, floor(len(v) * 0.95)::INT) + 1] AS p95 FROM s""")
def percentile_floor(spark, sf_dir):
    return metrics.floor_percentiles(read(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, round(coalesce(avg(value), 0), 6) AS mean, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY 1")
def mean_stddev(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("stddev"))


@query("""WITH t AS (SELECT user_id, date_part('hour', ts)::BIGINT AS step, max(value) AS v FROM events GROUP BY ALL), a AS (SELECT DISTINCT user_id, 12::BIGINT AS step FROM t), l AS (SELECT user_id, arg_max(v, step) AS v FROM t GROUP BY 1)
SELECT a.user_id, a.step, CASE WHEN t.user_id IS NOT NULL THEN t.v ELSE l.v END AS v FROM a LEFT JOIN t ON t.user_id = a.user_id AND t.step = a.step LEFT JOIN l ON l.user_id = a.user_id""")
def truth_at(spark, sf_dir):
    truth = read(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").cast("long").alias("step")).agg(F.max("value").alias("v"))
    return metrics.truth_at(truth, truth.select("user_id").distinct().withColumn("step", F.lit(12).cast("long")), "user_id", "step", "v")


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity), 2) AS total, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def cart_total(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')")
def product_search(spark, sf_dir):
    has = lambda c: F.contains(F.lower(c), F.lit("red"))
    return read(spark, sf_dir, "part").where(has("p_name") | has("p_type")).select("p_partkey")


# ---- the flagship: what personal data the sources hold, and what a policy does with it
@query(f"""WITH probe AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(map(found_sql, _NAMES))}, v AS ({" UNION ALL ".join(f"SELECT * FROM {n}" for n in _NAMES)})
SELECT source, type AS pii_type, CASE WHEN tier = 1 THEN 'VAULT_ONLY' WHEN confidence >= 0.8 THEN 'DROP' ELSE 'MASK' END AS action, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM v JOIN documents USING (doc_id) GROUP BY ALL""")
def pii_inventory(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = docs.select("doc_id", "source", F.explode(recognize.recognize(F.col("text"), _NAMES)).alias("s"))
    action = fusion.decide("BALANCED", F.col("s.confidence"), F.col("s.tier"))
    return found.groupBy("source", F.col("s.type").alias("pii_type"), action.alias("action")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
