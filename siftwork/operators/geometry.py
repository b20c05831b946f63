"""Rectangles as columns, and joins of overlapping rectangles by a grid.

A rectangle is a struct<x, y, w, h double>. Touching edges do not intersect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import let

CELL = 64


def rect(x, y, w, h) -> Column:
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), col(w).cast("double").alias("w"), col(h).cast("double").alias("h"))


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def contains(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (a["x"] + a["w"] > b["x"]) & (a["y"] < b["y"] + b["h"]) & (a["y"] + a["h"] > b["y"])


def _span(a: Column, b: Column, at: str, size: str, low, high) -> tuple[Column, Column]:
    lo = low(a[at], b[at])
    return lo, high(a[at] + a[size], b[at] + b[size]) - lo


def intersect(a: Column, b: Column) -> Column:
    """The common part, null where there is none."""
    (x, w), (y, h) = _span(a, b, "x", "w", F.greatest, F.least), _span(a, b, "y", "h", F.greatest, F.least)
    return F.when(intersects(a, b), rect(x, y, w, h))


def union(a: Column, b: Column) -> Column:
    """The bounding box."""
    (x, w), (y, h) = _span(a, b, "x", "w", F.least, F.greatest), _span(a, b, "y", "h", F.least, F.greatest)
    return rect(x, y, w, h)


def iou(a: Column, b: Column) -> Column:
    both = F.coalesce(area(intersect(a, b)), F.lit(0.0))
    total = area(a) + area(b) - both
    return F.when((both == 0) | (total == 0), 0.0).otherwise(both / total)


def quantize(v: Column, step: float = 4) -> Column:
    """Nearest multiple, halves upwards."""
    return (F.floor(v / step + 0.5) * step).cast("double")


def quantize_rect(r: Column, step: float = 4) -> Column:
    return rect(*[quantize(r[k], step) for k in "xywh"])


def scale(r: Column, sx, sy) -> Column:
    return rect(r["x"] * sx, r["y"] * sy, r["w"] * sx, r["h"] * sy)


def point_in(r: Column, px: Column, py: Column) -> Column:
    return px.between(r["x"], r["x"] + r["w"]) & py.between(r["y"], r["y"] + r["h"])


def expand(r: Column, by) -> Column:
    return rect(r["x"] - by, r["y"] - by, r["w"] + 2 * by, r["h"] + 2 * by)


def center(r: Column) -> Column:
    return F.struct((r["x"] + r["w"] / 2).alias("x"), (r["y"] + r["h"] / 2).alias("y"))


def clamp(r: Column, bounds: Column) -> Column:
    """Moved, and where it has to be shrunk, into bounds."""
    at = lambda k, n: F.greatest(bounds[k], F.least(r[k], bounds[k] + bounds[n] - r[n]))
    return rect(at("x", "w"), at("y", "h"), F.least(r["w"], bounds["w"]), F.least(r["h"], bounds["h"]))


def overlap_fraction(of: Column, by: Column) -> Column:
    """Share of `of` that `by` covers."""
    return F.when(area(of) > 0, F.coalesce(area(intersect(of, by)), F.lit(0.0)) / area(of)).otherwise(0.0)


def area_union(rects: Column) -> Column:
    """Area covered by an array of rectangles, by the cells between their edges. Without two different edges either way: the bounding box's."""

    def cells(rs: Column) -> Column:
        edges = lambda at, size: F.array_sort(F.array_distinct(F.concat(F.transform(rs, lambda r: r[at]), F.transform(rs, lambda r: r[at] + r[size]))))

        def total(xs: Column) -> Column:
            def column(ys: Column) -> Column:
                height = lambda x0, x1: F.aggregate(F.sequence(F.lit(0), F.size(ys) - 2), F.lit(0.0), lambda s, j: s + F.when(F.exists(rs, lambda r: (r["x"] <= x0) & (r["x"] + r["w"] >= x1) & (r["y"] <= F.get(ys, j)) & (r["y"] + r["h"] >= F.get(ys, j + 1))), F.get(ys, j + 1) - F.get(ys, j)).otherwise(0.0))
                swept = F.aggregate(F.sequence(F.lit(0), F.size(xs) - 2), F.lit(0.0), lambda s, i: s + (F.get(xs, i + 1) - F.get(xs, i)) * height(F.get(xs, i), F.get(xs, i + 1)))
                return F.when((F.size(xs) < 2) | (F.size(ys) < 2), 0.0).otherwise(swept)

            return let(edges("y", "h"), column)

        return let(edges("x", "w"), total)

    return F.when(F.size(rects) == 0, 0.0).otherwise(let(rects, cells))


def overlap_join(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, left_rect: str = "rect", right_rect: str = "rect", cell: int = CELL, pages: bool = False) -> DataFrame:
    """(group, left_id, l, right_id, r): pairs of one group whose rectangles intersect, each once.

    Both sides go into every grid cell that they touch and meet by (group, cell). A pair that shares several cells is kept in the
    first of them only, so nothing has to be made distinct. Ids are unique within a group and side, and may be structs of all that is to be known of a row.
    pages: groups are small, such as pages, and all pairs of one are compared, without cells. Neither side is sent to all tasks then: files of rectangles are so
    much smaller than their rows that Spark would take large tables for small ones.
    """
    side = lambda df, ident, name, to: df.select(F.col(group), F.col(ident).alias(f"{to}_id"), F.col(name).alias(to)).where(F.col(to).isNotNull())
    told = lambda pairs: pairs.select(group, F.col("l_id").alias(left_id), "l", F.col("r_id").alias(f"r_{right_id}" if left_id == right_id else right_id), "r")
    left, right = side(left, left_id, left_rect, "l"), side(right, right_id, right_rect, "r")
    if pages:
        return told(left.join(right.hint("merge"), group).where(intersects(F.col("l"), F.col("r"))))

    def celled(df: DataFrame, to: str) -> DataFrame:
        r = F.col(to)
        span = lambda at, size: F.sequence(F.floor(r[at] / cell), F.greatest(F.floor(r[at] / cell), F.ceil((r[at] + r[size]) / cell) - 1))
        return df.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))

    both = celled(left, "l").join(celled(right, "r"), [group, "cx", "cy"]).where(intersects(F.col("l"), F.col("r")))
    first = lambda at, c: F.col(c) == F.floor(F.greatest(F.col("l")[at], F.col("r")[at]) / cell)
    return told(both.where(first("x", "cx") & first("y", "cy")))
