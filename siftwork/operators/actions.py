"""Actions that a planner proposes, against the observation it was given: repairs, checks in order, risks, and what the planner is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import session

#: Of these every element is capable.
ANYWHERE = ("PRESS_KEY", "SCROLL")


def _target(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """actions(obs, target_id, ...) with the element that they name as __e, null where the observation has none."""
    fields = F.struct("id", "id_hash", "visible", "enabled", "available_actions", "sensitivity_class", "label_raw", "tag").alias("__e")
    return actions.join(elements.select("obs", F.col("id").alias("target_id"), fields), ["obs", "target_id"], "left")


def vault_type_match(kind: Column, target: Column, value_kind: Column, handle: Column) -> Column:
    """Code of a handle that may not go into its target's class, else null. kind is the action's, target an element or null."""
    h, cls = session.handle_kind(handle), target["sensitivity_class"]
    accepts = F.when(F.coalesce(cls, F.lit("NONE")) != "NONE", F.array(cls)).otherwise(F.array().cast("array<string>"))
    code = F.when(target.isNull(), "UNKNOWN_TARGET").when(handle.isNotNull() & ((h == "NONE") | ~session.binding_allowed(h, accepts)), "VAULT_TYPE_MISMATCH")
    return F.when((kind == "TYPE") & (value_kind == "vault_ref"), code)


def validate(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """actions(action_id, obs, current_obs, type, target_id, target_hash, url, value_kind, handle, secret boolean) with code: the first check that fails, else null. Actions
    without a target skip its checks; secret says whether a literal holds what the session knows (see gate.literal_scan)."""
    e, kind = F.col("__e"), F.col("type")
    aimed = F.col("target_id").isNotNull()
    unable = (F.size(e["available_actions"]) > 0) & ~F.array_contains(e["available_actions"], kind) & ~kind.isin(*ANYWHERE)
    typed = kind == "TYPE"
    code = (
        F.when(F.col("obs") != F.col("current_obs"), "STALE_OBSERVATION")
        .when(aimed & e.isNull(), "UNKNOWN_TARGET").when(aimed & (e["id_hash"] != F.col("target_hash")), "IDENTITY_MISMATCH").when(aimed & ~e["visible"], "ELEMENT_OBSCURED")
        .when(aimed & ~e["enabled"], "ELEMENT_DISABLED").when(aimed & unable, "UNSUPPORTED_ACTION")
        .when((kind == "NAVIGATE") & F.col("url").rlike(r"^\s*([A-Za-z][A-Za-z0-9+.-]*:|[/\\]{2})"), "ORIGIN_NOT_ALLOWED")
        .when(vault_type_match(kind, e, F.col("value_kind"), F.col("handle")).isNotNull(), "VAULT_TYPE_MISMATCH")
        .when(typed & (F.col("value_kind") == "literal") & F.col("secret"), "LITERAL_CONTAINS_SECRET").when(typed & (F.col("value_kind") == "user_input"), "UNSUPPORTED_ACTION")
    )
    return _target(actions, elements).withColumn("code", code).drop("__e")


def risk_of(kind: Column, label: Column, flagged: Column, risk: Column, confirm: tuple[str, ...] = schema.CONFIRM) -> Column:
    """struct<confirm, level>: does an action need a user's word?"""
    said = lambda yes, level: F.struct(yes.alias("confirm"), level.alias("level"))
    has = lambda c: F.lit(c in confirm)
    label, high = F.lower(F.coalesce(label, F.lit(""))), F.lit("high")
    return (
        F.when(kind == "NAVIGATE", said(has("NAVIGATE_EXTERNAL"), high)).when((kind == "CLICK") & label.rlike(schema.PAYING), said(has("PAYMENT") | flagged, high))
        .when((kind == "CLICK") & label.rlike(schema.DELETING), said(has("DELETE"), high)).when(flagged | (risk == "high"), said(F.lit(True), high)).otherwise(said(F.lit(False), risk))
    )


def guard(answers: DataFrame, elements: DataFrame, handles: DataFrame) -> DataFrame:
    """answers(action_id, obs, said_obs, type, target_id, target_hash, risk, requires_confirmation, value_kind, handle, evidence) repaired, with error: what a
    planner left out is filled in from the observation; what it refers to must be there."""
    e = F.col("__e")
    rows = _target(answers, elements)
    rows = rows.withColumn("target_hash", F.coalesce(F.nullif("target_hash", F.lit("")), e["id_hash"])).withColumn("said_obs", F.coalesce("said_obs", "obs"))
    rows = rows.withColumn("risk", F.coalesce("risk", F.lit("low"))).withColumn("requires_confirmation", F.coalesce("requires_confirmation", F.lit(False)))
    rows = rows.join(handles.select("obs", "handle").distinct().withColumn("__known", F.lit(True)), ["obs", "handle"], "left")
    rows = rows.join(elements.select("obs", F.col("id").alias("evidence")).distinct().withColumn("__there", F.lit(True)), ["obs", "evidence"], "left")
    aimed = F.col("target_id").isNotNull()
    unable = (F.size(e["available_actions"]) > 0) & ~F.array_contains(e["available_actions"], F.col("type")) & ~F.col("type").isin(*ANYWHERE)
    error = (
        F.when(F.col("type").isNull(), "INVALID").when(F.col("said_obs") != F.col("obs"), "STALE_OBSERVATION").when(aimed & e.isNull(), "UNKNOWN_TARGET").when(aimed & (e["id_hash"] != "") & (e["id_hash"] != F.col("target_hash")), "IDENTITY_MISMATCH")
        .when(aimed & ~e["visible"], "ELEMENT_NOT_VISIBLE").when(aimed & unable, "UNSUPPORTED_ACTION").when((F.col("type") == "TYPE") & (F.col("value_kind") == "vault_ref") & F.col("__known").isNull(), "UNKNOWN_HANDLE")
        .when((F.col("type") == "DONE") & F.col("evidence").isNotNull() & F.col("__there").isNull(), "UNKNOWN_TARGET")
    )
    return rows.withColumn("error", error).drop("__e", "__known", "__there")


def element_line(wrap=lambda s: F.concat(F.lit("<untrusted_page_content>"), s, F.lit("</untrusted_page_content>"))) -> Column:
    """A planner's line about an element(id, tag, type, role, label_raw, placeholder_raw, sensitivity_class, enabled, available_actions, id_hash)."""
    name = F.coalesce(F.nullif("label_raw", F.lit("")), F.nullif("placeholder_raw", F.lit("")))
    notable = F.filter("available_actions", lambda a: a.isin("TYPE", "SELECT"))
    kind = F.concat(F.lit("<"), "tag", F.coalesce(F.concat(F.lit(" type="), F.nullif("type", F.lit(""))), F.lit("")), F.lit(" role="), "role", F.lit(">"))
    parts = (F.col("id"), kind, wrap(name), F.concat(F.lit("accepts="), "sensitivity_class"), F.when(~F.col("enabled"), "disabled"), F.when(F.size(notable) > 0, F.concat(F.lit("actions="), F.array_join(notable, "/"))), F.concat(F.lit("id_hash="), "id_hash"))
    return F.concat(F.lit("  "), F.concat_ws(" ", *parts))


def worth_showing() -> Column:
    """Elements that can be acted on or read."""
    named = (F.coalesce("label_raw", F.lit("")) != "") | (F.coalesce("placeholder_raw", F.lit("")) != "")
    return F.col("visible") & (F.col("tag").isin(*schema.INTERACTIVE_TAGS, "summary", "option") | F.col("role").isin(*schema.PROMPT_ROLES) | F.col("sensitivity_class").isNotNull() | named)


def prompt(elements: DataFrame) -> DataFrame:
    """(obs, prompt): the lines of each page's elements worth showing, in order, under a line that counts them."""
    shown = worth_showing()
    lines = elements.groupBy("obs").agg(F.count("*").alias("n"), F.count_if(shown).alias("shown"), F.array_sort(F.collect_list(F.when(shown, F.struct("ord", element_line().alias("line"))))).alias("lines"))
    head = F.concat(F.lit("Elements ("), F.col("shown").cast("string"), F.lit(" you can act on, of "), F.col("n").cast("string"), F.lit(" observed):"))
    return lines.select("obs", F.concat_ws("\n", head, F.transform("lines", lambda x: x["line"])).alias("prompt"))


def history(actions: DataFrame, last: int = 8) -> DataFrame:
    """(session, history): the last actions(session, step, type, target_id, handle, literal) as a planner is told them."""
    what = F.concat(F.col("type"), F.coalesce(F.concat(F.lit("("), "target_id", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" ← "), "handle"), F.concat(F.lit(' ← "'), F.substring("literal", 1, 40), F.lit('"')), F.lit("")))
    per = actions.groupBy("session").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("step", F.concat(F.lit("  step "), F.col("step").cast("string"), F.lit(": "), what).alias("line")))).alias("lines"))
    head = F.concat(F.lit("Previous actions ("), F.col("n").cast("string"), F.lit(" so far, last "), F.least("n", F.lit(last)).cast("string"), F.lit(" shown):"))
    kept = F.slice("lines", F.greatest(F.size("lines") - last, F.lit(0)) + 1, F.lit(last))
    return per.select("session", F.concat_ws("\n", head, F.transform(kept, lambda x: x["line"])).alias("history"))


def predicate(kind: Column, url: Column, text: Column, pattern: Column, fields: Column, wanted: Column, outcome: Column, codes: Column) -> Column:
    """Does a run's end hold: an address's pattern, fields' values, a text on the page, an item in the cart, an outcome, a block?"""
    match = F.forall(F.map_entries(wanted), lambda w: F.trim(F.coalesce(F.try_element_at(fields, w["key"]), F.lit("<missing>"))) == F.trim(w["value"]))
    return (
        F.when(kind == "url_matches", F.call_function("regexp_like", url, pattern)).when(kind == "field_values", match).when(kind == "page_contains", F.contains(F.lower(text), F.lower(pattern)))
        .when(kind == "cart_contains", F.map_contains_key(fields, pattern)).when(kind == "outcome", outcome == F.coalesce(pattern, F.lit("success"))).when(kind == "blocked_with", F.array_contains(codes, pattern))
    )
