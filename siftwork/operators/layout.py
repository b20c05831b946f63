"""Where things are on a screen: device pixels and scales, crops of what a page can't explain, and what explains a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwork import schema
from siftwork.operators import geometry as G


def half_up(v: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(v + 0.5)


def _each(r: Column, f) -> Column:
    return G.rect(*[f(r[k]) for k in "xywh"])


def to_bitmap(r: Column, dpr) -> Column:
    """Style pixels to device pixels; every hop rounds."""
    return _each(r, lambda v: half_up(v * dpr))


def from_bitmap(r: Column, dpr) -> Column:
    return _each(r, lambda v: half_up(v / dpr))


def to_downscaled(r: Column, dpr, scale) -> Column:
    return _each(to_bitmap(r, dpr), lambda v: half_up(v * scale))


def from_downscaled(r: Column, dpr, scale) -> Column:
    return _each(r, lambda v: half_up(v / scale / dpr))


def scale_factor(w: Column, h: Column, longest: int = schema.LONG_SIDE) -> Column:
    """By how much a picture shrinks so that its long side fits; 1 where it does."""
    side = F.greatest(w, h)
    return F.when(side <= longest, 1.0).otherwise(F.lit(float(longest)) / side)


def in_viewport(r: Column, w, h, margin: int = schema.VIEW_MARGIN) -> Column:
    """Does a rectangle touch the viewport or the margin around it?"""
    return (r["x"] + r["w"] >= -margin) & (r["y"] + r["h"] >= -margin) & (r["x"] <= w + margin) & (r["y"] <= h + margin)


def crop_geometry(r: Column, w, h, longest: int = schema.CROP_SIDE) -> Column:
    """struct<rect, scale, width, height>: the part of a region in the viewport, and the picture of it."""
    w, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (w, h))
    x, y = (F.greatest(F.lit(0.0), F.least(r[k], size - 1)) for k, size in (("x", w), ("y", h)))
    cw, ch = F.greatest(F.lit(1.0), F.least(r["w"], w - x)), F.greatest(F.lit(1.0), F.least(r["h"], h - y))
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(cw, ch))
    side = lambda v: F.greatest(F.lit(1).cast("long"), half_up(v * scale))
    return F.struct(G.rect(x, y, cw, ch).alias("rect"), scale.alias("scale"), side(cw).alias("width"), side(ch).alias("height"))


def box_to_viewport(box: Column, crop: Column) -> Column:
    """A box in a crop's picture, struct<x0, y0, x1, y1>, as a rectangle of the viewport."""
    s, r = crop["scale"], crop["rect"]
    return G.rect(r["x"] + box["x0"] / s, r["y"] + box["y0"] / s, (box["x1"] - box["x0"]) / s, (box["y1"] - box["y0"]) / s)


def suspicion() -> Column:
    """How likely pixels of an element(tag, type, autocomplete) hold what the page doesn't tell."""
    tag = F.lower("tag")
    pixels = F.when(tag == "canvas", 0.3).when(tag.isin("img", "svg"), 0.2).otherwise(0.0)
    secret = F.when(F.coalesce(F.col("type"), F.lit("")) == "password", 0.3).otherwise(0.0)
    named = F.when(F.coalesce(F.col("autocomplete"), F.lit("")).rlike("address|name|email|tel|cc-"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.3) + pixels + secret + named)


def unexplained_regions(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """(obs, ord, rect, reason, area, suspicion): what elements(obs, ord, tag, type, autocomplete, rect, visible, unexplained) and
    frames(obs, ord, rect, origin) show but don't tell; of equal rectangles of a page the first, elements before frames."""
    tag = F.lower("tag")
    reason = F.when(F.col("unexplained"), "unexplained_element").when(tag.isin(*schema.OPAQUE_TAGS), F.concat(F.lit("opaque_"), tag))
    of_elements = elements.where("visible").select("obs", F.lit(0).alias("phase"), "ord", "rect", reason.alias("reason"), suspicion().alias("suspicion")).where("reason IS NOT NULL")
    of_frames = frames.where("origin = 'cross'").select("obs", F.lit(1).alias("phase"), "ord", "rect", F.lit("cross_origin_iframe").alias("reason"), F.lit(0.9).alias("suspicion"))
    both = of_elements.unionByName(of_frames).where("rect.w > 0 AND rect.h > 0")
    first = both.groupBy("obs", "rect").agg(F.min(F.struct("phase", "ord", "reason", "suspicion")).alias("f"))
    return first.select("obs", "f.ord", "rect", "f.reason", G.area(F.col("rect")).alias("area"), "f.suspicion")


def ocr_skip(observations: DataFrame, regions: DataFrame) -> DataFrame:
    """(obs, reason): why there is nothing to read on a page, null where there is."""
    some = regions.select("obs").distinct().withColumn("some", F.lit(True))
    return observations.select("obs").join(some, "obs", "left").select("obs", F.when(F.col("some").isNull(), "no_unexplained_crops").alias("reason"))


def partition_explained(elements: DataFrame, texts: DataFrame, frames: DataFrame, sensitive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates(obs, id, rect, reason), explained(obs, eid, rect)): regions that need an owner and rectangles that can be one. Elements
    of sensitive(obs, id) are accounted for but vouch for no neighbour; texts that were read always do; frames of other origins never."""
    seen = elements.where("visible")
    tag = F.lower("tag")
    reason = F.when(F.col("unexplained"), F.concat(F.lit("unexplained <"), "tag", F.lit("> region"))).when(tag.isin(*schema.OPAQUE_TAGS), F.concat(F.lit("opaque <"), "tag", F.lit(">, contents unreadable from the DOM")))
    seen = seen.withColumn("reason", reason)
    name = lambda kind: F.concat(F.lit(kind), F.col("id").cast("string"))
    crossing = frames.where("origin = 'cross'").select("obs", name("f").alias("id"), "rect", F.lit("cross-origin iframe").alias("reason"))
    candidates = seen.where("reason IS NOT NULL").select("obs", name("e").alias("id"), "rect", "reason").unionByName(crossing)
    owners = seen.where("reason IS NULL").join(sensitive.select("obs", "id").distinct(), ["obs", "id"], "left_anti").select("obs", name("e").alias("eid"), "rect")
    return candidates, owners.unionByName(texts.select("obs", name("t").alias("eid"), "rect"))


def value_state() -> Column:
    """filled, empty or n/a of a control(tag, type, checked, placeholder, required, value, selected, option_value), without telling its value."""
    kind = F.lower(F.coalesce(F.col("type"), F.lit("text")))
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    state = lambda is_empty: F.when(is_empty, "empty").otherwise("filled")
    of_input = F.when(kind.isin(*schema.STATELESS_TYPES), "n/a").when(kind.isin("checkbox", "radio"), state(~F.coalesce(F.col("checked"), F.lit(False)))).when(F.col("placeholder").isNotNull() | F.coalesce(F.col("required"), F.lit(False)), state(empty)).otherwise("n/a")
    of_select = F.when(F.coalesce(F.col("selected"), F.lit(-1)) < 0, "empty").otherwise(state(F.coalesce(F.col("option_value") == "", F.lit(False))))
    return F.when(F.col("tag") == "input", of_input).when(F.col("tag") == "textarea", state(empty)).when(F.col("tag") == "select", of_select).otherwise("n/a")


def class_fallback() -> Column:
    """A coarse class of an element(type, autocomplete, role, label_raw) that no rule named."""
    has = lambda *parts: F.coalesce(F.col("autocomplete").rlike("|".join(parts)), F.lit(False))
    is_type = lambda t: F.coalesce(F.col("type") == t, F.lit(False))
    heading = F.coalesce((F.col("role") == "heading") & F.lower("label_raw").contains("name"), F.lit(False))
    return (
        F.when(is_type("password") | has("cc-", "password", "one-time-code"), "PASSWORD").when(is_type("email") | has("email"), "EMAIL").when(is_type("tel") | has("tel"), "PHONE")
        .when(has("address", "street", "postal"), "ADDRESS").when(has("name") | heading, "NAME").when(has("bday", "birth"), "PERSONAL").when(is_type("search") | F.coalesce(F.col("role") == "searchbox", F.lit(False)), "NONE")
    )


def page_type(path: Column, query: Column, title: Column, passwords: Column, inputs: Column, links: Column, lists: Column) -> Column:
    """What a page is for, by its address, title and the counts of its elements."""
    path, about = F.lower(path), F.lower(F.concat(path, F.lit(" "), title))
    return (
        F.when(passwords > 0, "auth").when(about.rlike("checkout|payment|shipping"), "checkout").when(F.concat(path, F.lit(" "), query).rlike(r"search|results|\?q="), "search")
        .when(inputs >= 3, "form").when((lists >= 2) & (links > 8), "list").when(path.rlike("product|item|order|patient|detail"), "detail").otherwise("other")
    )


def firsts_of_kind(rows: DataFrame, key: str, kind: str, order: str, value: str, wanted: dict[str, tuple[str, int]], fallback: bool) -> DataFrame:
    """(key, a column for each wanted name): the nth value of a kind in order; where there are fewer the first (fallback) or ''."""
    nth = rows.withColumn("__n", F.row_number().over(W.partitionBy(key, kind).orderBy(order)) - 1)
    at = lambda k, n: F.max(F.when((F.col(kind) == k) & (F.col("__n") == n), F.col(value)))
    pick = lambda k, n: F.coalesce(at(k, n), *([at(k, 0)] if fallback and n else []), F.lit(""))
    return nth.groupBy(key).agg(*[pick(k, n).alias(name) for name, (k, n) in wanted.items()])
