"""Handles for values of a session, and putting them in the values' place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema, tables
from siftwork.functions.text import let, normalize_any

from . import contain

LEFT, RIGHT = "⟦", "⟧"
#: Values of a session up to which a text of it is held against each of them.
LOT = 256
#: Values of all sessions up to which Spark may send them to all tasks: told by their number, since their files are far smaller than they are.
SENT = 200_000
HANDLE = r"^⟦[A-Z_]+(#[0-9]+)?⟧$"


def handle(kind: Column, tier: Column, index: Column) -> Column:
    """Secrets of the first tier show no index, though they use one up."""
    return F.when(tier == 1, F.concat(F.lit(LEFT), kind, F.lit(RIGHT))).otherwise(F.concat(F.lit(LEFT), kind, F.lit("#"), index.cast("string"), F.lit(RIGHT)))


def key_of(value: Column) -> Column:
    """What values that are the same have in common."""
    return normalize_any()(value)


def numbered(values: DataFrame) -> DataFrame:
    """(session, key, kind, tier, index, handle) for values(session, ord, value, type, tier): each normalized value once, by first appearance, with its first type. Values are pre-aggregated before they are ranked."""
    first = values.withColumn("key", key_of(F.col("value"))).groupBy("session", "key").agg(F.min(F.struct("ord", "type", "tier")).alias("f"))
    index = F.row_number().over(W.partitionBy("session").orderBy("f.ord", "key"))
    out = first.select("session", "key", F.col("f.type").alias("kind"), F.col("f.tier").alias("tier"), F.col("f.ord").alias("first_ord"), index.alias("index"))
    return out.withColumn("handle", handle(F.col("kind"), F.col("tier"), F.col("index")))


def register(values: DataFrame) -> DataFrame:
    """numbered() without handles that an earlier value of the session has: a second secret of a type is not registered."""
    return numbered(values).withColumn("nth", F.row_number().over(W.partitionBy("session", "handle").orderBy("first_ord", "key"))).where("nth = 1").drop("nth")


def substitute(text: Column, pairs: Column) -> Column:
    """text with the values of pairs array<struct<value, handle>> replaced, longest first: as written where it occurs so, else in any case. Values under three characters stay."""
    order = F.transform(F.array_sort(F.transform(F.filter(pairs, lambda p: F.length(p["value"]) >= 3), lambda p, i: F.struct((-F.length(p["value"])).alias("n"), i.alias("i"), p["value"].alias("value"), p["handle"].alias("handle")))), lambda p: p)
    quoted = lambda v: F.concat(F.lit("(?i)\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.aggregate(order, text, lambda t, p: F.when(F.contains(t, p["value"]), F.replace(t, p["value"], p["handle"])).otherwise(F.regexp_replace(t, quoted(p["value"]), p["handle"])))


def substitute_known(rows: DataFrame, text_col: str, handles: DataFrame, key: list[str]) -> DataFrame:
    """rows with all values of three characters or more that their own session knows, handles(session, key, handle), replaced in text_col. The
    columns of key tell rows of a session apart."""
    # read twice, and recognizing may stand behind them
    handles = tables.cut(handles.select("session", "key", "handle"), "handles")
    each = handles.where(F.length("key") >= 3).groupBy("session")
    count = each.agg(F.count("*").alias("n"))
    told = count.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    sent = (told["all"] or 0) <= SENT
    if (told["most"] or 0) <= LOT:
        return _written(_of_session(rows, text_col, each, sent), text_col, rows.columns)
    many = tables.cut(count.where(F.col("n") > LOT).select("session"), "large-sessions")
    same = F.col("r.session").eqNullSafe(F.col("m.session"))
    part = lambda df, how: df.alias("r").join(many.alias("m"), same, how)
    # sessions of many values: texts and values meet by their characters
    large = _written(_by_characters(part(rows, "left_semi"), text_col, part(handles, "left_semi"), key), text_col, rows.columns)
    few = part(handles, "left_anti").where(F.length("key") >= 3).groupBy("session")
    return _written(_of_session(part(rows, "left_anti"), text_col, few, sent), text_col, rows.columns).unionByName(large)


def _of_session(rows: DataFrame, text_col: str, handles, sent: bool) -> DataFrame:
    """rows as r with __known: the values of their session, handles grouped by it, that the text holds in any case. sent: all of them may be sent to all tasks."""
    of = handles.agg(F.collect_list(F.struct("key", "handle")).alias("__all")).alias("p")
    out = rows.alias("r").join(of if sent else of.hint("merge"), F.col("r.session").eqNullSafe(F.col("p.session")), "left")
    return out.withColumn("__known", let(F.lower(F.col(f"r.{text_col}")), lambda low: F.filter("__all", lambda k: F.contains(low, k["key"]))))


def _by_characters(rows: DataFrame, text_col: str, handles: DataFrame, key: list[str]) -> DataFrame:
    """The same by contain.holding(), null where there is none."""
    low = rows.select("session", F.struct(*key).alias("__row"), F.lower(text_col).alias("__low"))
    held = contain.holding(low, handles.select("session", "key"), "__row", "__low", "key", within="session").withColumnRenamed("pattern", "key")
    same = held["key"].eqNullSafe(handles["key"]) & held["session"].eqNullSafe(handles["session"])
    known = held.join(handles, same).groupBy(held["session"], "__row").agg(F.collect_list(F.struct(held["key"], "handle")).alias("__known")).alias("p")
    return rows.withColumn("__row", F.struct(*key)).alias("r").join(known, F.col("r.session").eqNullSafe(F.col("p.session")) & (F.col("r.__row") == F.col("p.__row")), "left")


def _written(out: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """The columns of rows r with the values of __known replaced in text_col."""
    # as each is written in the text
    quoted = lambda k: F.concat(F.lit("(?i)\\Q"), F.replace(k, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    written = lambda k: F.transform(F.array_distinct(F.call_function("regexp_extract_all", F.col(f"r.{text_col}"), quoted(k["key"]), F.lit(0))), lambda v: F.struct(v.alias("value"), k["handle"].alias("handle")))
    out = out.withColumn("__pairs", F.array_sort(F.array_distinct(F.flatten(F.transform("__known", written)))))
    text = F.when(F.col("__pairs").isNotNull(), substitute(F.col(f"r.{text_col}"), F.col("__pairs"))).otherwise(F.col(f"r.{text_col}"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"r.{c}") for c in columns])


def handle_kind(h: Column) -> Column:
    kind = F.regexp_extract(h, "⟦([^#⟧]+)[#⟧]", 1)
    return F.when(kind == "", "NONE").otherwise(kind)


def norm_type(name: Column) -> Column:
    """One vocabulary: aliases replaced, unknown names PERSONAL, none NONE."""
    upper = F.upper(name)
    alias = upper
    for a, b in schema.ALIASES.items():
        alias = F.when(upper == a, b).otherwise(alias)
    known = set(schema.TIERS) - set(schema.ALIASES) | {"PERSONAL", "NONE", "USERNAME", "API_KEY", "TOKEN", "SSN", "FINANCIAL", "HEALTH"}
    return F.when(F.coalesce(name, F.lit("")) == "", "NONE").when(alias.isin(*sorted(known)), alias).otherwise("PERSONAL")


def binding_allowed(kind: Column, accepts: Column) -> Column:
    """May a value of this type go into a field that accepts these types? Fields that say nothing take quasi-identifiers only."""
    kind, fields = norm_type(kind), F.filter(F.transform(accepts, norm_type), lambda a: a != "NONE")
    allowed = F.array(kind)
    for k, into in schema.ACCEPTED.items():
        allowed = F.when(kind == k, F.array(*map(F.lit, into))).otherwise(allowed)
    return F.when(F.size(fields) == 0, kind.isin(*schema.FREE_TEXT_ACCEPTS)).otherwise(F.arrays_overlap(fields, allowed))


def resolve(asked: DataFrame, vault: DataFrame) -> DataFrame:
    """asked(handle, accepts array<string>) with value or code: what vault(handle, type, value) holds, where it may go into the field."""
    found = asked.join(vault.select("handle", F.col("type").alias("__type"), F.col("value").alias("__value"), F.lit(True).alias("__found")), "handle", "left")
    allowed = binding_allowed(F.col("__type"), F.col("accepts"))
    code = F.when(F.col("__found").isNull(), "HANDLE_NOT_FOUND").when(~allowed, "VAULT_TYPE_MISMATCH")
    return found.withColumn("code", code).withColumn("value", F.when(F.col("code").isNull(), F.col("__value"))).drop("__type", "__value", "__found")


def ner_type(label: Column) -> Column:
    """A model's entity label as a type; never one of the first tier."""
    known = F.create_map(*[F.lit(x) for pair in schema.NER_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(label)), F.lit("PERSONAL"))


def summarize(handles: DataFrame) -> DataFrame:
    """(type, tier, n, occurrences) over handles(type, tier, occurrences)."""
    return handles.groupBy("type").agg(F.min("tier").alias("tier"), F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"))
