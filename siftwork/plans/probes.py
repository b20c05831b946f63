"""Queries of the recognizers over documents, each text followed by a line of test vectors, and their SQL twins.

The driver's documents hold mail addresses, card numbers and IPv4 addresses only. Every document therefore gets one vector line,
chosen by its id, so that each recognizer meets accepted, rejected and adjacent cases in real text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import recognize

VECTORS = (
    "write to user@zmail.in or user+tag@sub.sample.co.uk, not user@example.com or a@b.test or user@@domain.com",
    "phone +91 99194 14773, +91-9876543210, 9876543210 and 98765432101; +44 2071234567 +91 5876543210",
    "id 234567890124 and 2345 6789 0124, 999999999999, 234567890123, 1234567890123 and 2345-6789-0124",
    "pan ABCDE1234F PQRST9012Z PRODU1234X ABCDE0000F abcde1234f XABCDE1234F",
    "ifsc SBIN0001234 UTIB0003456 XXXX0001234 SBIN1234567 gst 29ABCDE1234F1Z3 29ABCDE1234F1ZX 27PQRST5678G2ZV",
    "pay rahul.123@okhdfcbank or user@phonepe, ab@paytm, user@okhdfc, me_too@PayTM",
    "card 4532015112830366, 5555-5555-5555-4444, 378282246310005; sample 4242424242424242, bad 4532015112830367",
    "Order ID: 4532015112830366 then many other words to be far enough away from it 4532 0151 1283 0366",
    "hosts 192.168.1.1 256.1.1.1 1.2.3.4.5 2001:0db8:85a3:0000:0000:8a2e:0370:7334 fe80::1 ::1 gggg::1 1:2:3::4",
    "Date of birth: 1990-01-15, DOB 2000/12/25, born 1990-02-30, dob 2030-01-15 and dob 01/25/1990 birthday 02-03-1991",
    "key sk_live_abcdEFGH12345678 and QmFzZTY0VGV4dFdpdGhIaWdoRW50cm9weQ19 demo_abcdEFGH12345678ijklmnop aaaaaaaaaaaaaaaaaaaaaaaaaa",
    "mobile 9876543210 and 9123456789 with nothing else to tell",
)


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(*map(F.lit, VECTORS))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.get(lines, F.pmod("doc_id", F.lit(len(VECTORS))).cast("int"))).alias("text"))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def probe_sql() -> str:
    return f"probe AS (SELECT doc_id, coalesce(text, '') || chr(10) || ([{', '.join(map(q, VECTORS))}])[(doc_id % {len(VECTORS)} + 1)::INTEGER] AS text FROM documents)"


def spans_sql(name: str, pattern: str) -> str:
    """A common table of (doc_id, text, value, s, e) for the pattern's matches over probe: s and e are offsets in code points."""
    p = q(pattern)
    return f"""{name}_m AS (SELECT doc_id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM probe),
{name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name}_p AS (SELECT doc_id, text, m[i] AS value, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s FROM {name}_i),
{name} AS (SELECT doc_id, text, value, s::BIGINT AS s, (s + length(value))::BIGINT AS e, CASE WHEN s > 0 THEN substr(text, s::BIGINT, 1) ELSE '' END AS b, substr(text, (s + length(value) + 1)::BIGINT, 1) AS a,
  lower(CASE WHEN s > 0 THEN substr(text, greatest(s - 30, 0)::BIGINT + 1, least(s, 30)::BIGINT) ELSE '' END || substr(text, (s + length(value) + 1)::BIGINT, 30)) AS near30,
  lower(CASE WHEN s > 0 THEN substr(text, greatest(s - 20, 0)::BIGINT + 1, least(s, 20)::BIGINT) ELSE '' END || substr(text, s::BIGINT + 1, 20)) AS near20 FROM {name}_p)"""


def _not_near(cls: str) -> str:
    return f"NOT regexp_matches(b, '{cls}') AND NOT regexp_matches(a, '{cls}')"


_DIGITS = "regexp_replace(value, '[ -]', '', 'g')"
_D, _P = (f"[{', '.join(map(str, x))}]" for x in (schema.VERHOEFF_D, schema.VERHOEFF_P))
_VERHOEFF = f"list_reduce(list_prepend(0, list_transform(range(1, 13), lambda i: 100 * (({_P})[((i - 1) % 8) * 10 + substr({_DIGITS}, (13 - i)::BIGINT, 1)::INTEGER + 1]) + i)), lambda c, x: (({_D})[((c % 100) * 10 + x // 100 + 1)::INTEGER])) = 0"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INTEGER ELSE (substr(reverse({_DIGITS}), i, 1)::INTEGER * 2) % 10 + (substr(reverse({_DIGITS}), i, 1)::INTEGER * 2) // 10 END)) % 10 = 0"
_CODE = "(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(value, i, 1)) - 1)"
_GSTIN = f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ((36 - list_sum(list_transform(range(1, 15), lambda i: {_CODE} * i)) % 36) % 36 + 1)::BIGINT, 1) = substr(value, 15, 1)"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(length(value) - length(replace(value, c, '')))::DOUBLE / length(value) * log2((length(value) - length(replace(value, c, '')))::DOUBLE / length(value))))"


def _date(y: int, m: int, d: int) -> str:
    part = lambda i: f"regexp_split_to_array(value, '[-/.]')[{i}]::INTEGER"
    return f"(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', {part(y)}, {part(m)}, {part(d)}) AS DATE) IS NOT NULL AND {part(y)} BETWEEN 1900 AND {recognize.AS_OF - 13})"


#: Recognizer -> (condition, confidence, rule) in SQL, where the engine's patterns can say it.
RULES = {
    "email": (f"NOT regexp_matches(value, '(?i){schema.RESERVED_MAIL}')", "0.95", "'email-regex-v1'"),
    "phone_in_e164": ("NOT regexp_matches(b, '[0-9+]') AND NOT regexp_matches(a, '[0-9]')", "0.98", "'phone-e164-indian-v1'"),
    "phone_in_bare": ("NOT regexp_matches(b, '[0-9+]') AND NOT regexp_matches(a, '[0-9]')", f"CASE WHEN regexp_matches(near20, {q(schema.PHONE_CONTEXT)}) THEN 0.9 ELSE 0.7 END", f"CASE WHEN regexp_matches(near20, {q(schema.PHONE_CONTEXT)}) THEN 'phone-indian-v1' ELSE 'phone-indian-bare-v1' END"),
    "phone_generic": ("NOT starts_with(value, '+91') AND NOT regexp_matches(b, '[0-9+]') AND NOT regexp_matches(a, '[0-9]')", "0.85", "'phone-e164-generic-v1'"),
    "aadhaar": (f"{_not_near('[0-9]')} AND {_VERHOEFF}", "0.99", "'aadhaar-verhoeff-v1'"),
    "pan": (f"{_not_near('[A-Z0-9]')} AND NOT starts_with(value, 'PRODU') AND NOT regexp_matches(value, '^[A-Z]{{5}}0{{4}}[A-Z]$')", "0.95", "'pan-regex-v1'"),
    "ifsc": (f"{_not_near('[A-Z0-9]')} AND substr(value, 1, 4) IN ({', '.join(map(q, schema.BANK_CODES))})", "0.95", "'ifsc-regex-v1'"),
    "gstin": (f"{_not_near('[A-Z0-9]')} AND {_GSTIN}", "0.99", "'gstin-checkchar-v1'"),
    "upi": (_not_near(r"[a-zA-Z0-9.\-_@]") + f" AND length(string_split(value, '@')[1]) >= 3 AND lower(string_split(value, '@')[2]) IN ({', '.join(map(q, schema.UPI_HANDLES))})", "0.9", "'upi-vpa-v1'"),
    "card": (f"{_not_near('[0-9]')} AND NOT (contains(value, ' ') AND contains(value, '-')) AND {_DIGITS} NOT IN ({', '.join(map(q, schema.SAMPLE_CARDS))}) AND {_LUHN} AND NOT regexp_matches(near30, {q(schema.CARD_CONTEXT)})", "0.98", "'card-luhn-v1'"),
    "ipv4": (_not_near("[0-9.]"), "0.9", "'ip-v4-v1'"),
    "ipv6_full": (_not_near("[:0-9a-fA-F]"), "0.85", "'ip-v6-v1'"),
    "dob_iso": (_not_near(r"[0-9\-./]") + f" AND {_date(1, 2, 3)} AND regexp_matches(near30, {q(schema.DOB_CONTEXT)})", "0.9", "'dob-iso-v1'"),
    "dob_us": (_not_near(r"[0-9\-./]") + f" AND regexp_split_to_array(value, '[-/.]')[2]::INTEGER > 12 AND {_date(3, 1, 2)} AND regexp_matches(near30, {q(schema.DOB_CONTEXT)})", "0.85", "'dob-us-v1'"),
}


# runs of these characters are whole tokens, which is what the recognizer's look-arounds say
_TOKEN = "[A-Za-z0-9_-]"
RULES["secret"] = (f"NOT starts_with(value, 'demo') AND (regexp_matches(value, '^(sk|pk|api|token|secret|key)_{_TOKEN}{{{{16,}}}}$') OR (length(value) >= 24 AND {_ENTROPY} > {schema.ENTROPY_BITS}))".replace("{{", "{").replace("}}", "}"), "0.9", "'secret-entropy-v1'")
SQL_PATTERNS = schema.PATTERNS | {"secret": _TOKEN + "{19,}"}


def found_sql(name: str) -> str:
    """Common tables that end in one called name of (doc_id, start, end, value, type, tier, confidence, rule_id)."""
    keep, confidence, rule = RULES[name]
    kind = {"phone": "PHONE", "dob": "DOB", "ipv4": "IP", "ipv6": "IP"}.get(name.split("_")[0], name.upper())
    return f"""{spans_sql(name + "_s", SQL_PATTERNS[name])},
{name} AS (SELECT doc_id, s AS "start", e AS "end", value, '{kind}' AS type, {schema.TIERS[kind]} AS tier, ({confidence})::DOUBLE AS confidence, {rule} AS rule_id FROM {name}_s WHERE {keep})"""


def _recognizer(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return recognize.detect(probe(spark, sf_dir), "doc_id", "text", (name,)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", "type", "tier", "confidence", "rule_id")

    return run


def rec_text_all(spark: SparkSession, sf_dir: str, names=tuple(RULES)) -> DataFrame:
    """Of the recognizers that have a twin."""
    found = recognize.detect(probe(spark, sf_dir), "doc_id", "text", names)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"), F.count_if(F.col("tier") < 3).alias("identifiers"))


def rec_detect_all(spark: SparkSession, sf_dir: str, names=tuple(RULES)) -> DataFrame:
    found = recognize.detect(probe(spark, sf_dir), "doc_id", "text", names)
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


def rec_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all recognizers; compressed addresses can't be told in SQL."""
    return rec_text_all(spark, sf_dir, tuple(recognize.RECOGNIZERS))


def rec_detect_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec_detect_all(spark, sf_dir, tuple(recognize.RECOGNIZERS))


def _union_sql() -> str:
    return "WITH " + ",\n".join([probe_sql(), *map(found_sql, RULES)]) + ",\nevery AS (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in RULES) + ")"


QUERIES = {f"rec_{n}": _recognizer(n) for n in recognize.RECOGNIZERS} | {"rec_text_all": rec_text_all, "rec_detect_all": rec_detect_all, "rec_text_whole": rec_text_whole, "rec_detect_whole": rec_detect_whole}
ORACLES = {f"rec_{n}": f"WITH {probe_sql()},\n{found_sql(n)}\nSELECT * FROM {n}" for n in RULES} | {
    "rec_text_all": _union_sql() + ' SELECT doc_id, count(*)::BIGINT AS n, sum("start")::BIGINT AS starts, count(*) FILTER (tier < 3)::BIGINT AS identifiers FROM every GROUP BY doc_id',
    "rec_detect_all": _union_sql() + ' SELECT doc_id, type, count(*)::BIGINT AS n, min("start")::BIGINT AS first_start FROM every GROUP BY doc_id, type',
}
