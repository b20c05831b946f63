"""What a point of a page hits: the element painted last among those over it, by grid cells, without pairs of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import let

from . import geometry as G

#: Pixels by which corners are tested inside a rectangle, and beyond the viewport that still count as in it.
INSET, MARGIN = 2, 50


def topmost(points: DataFrame, elements: DataFrame, cell: int = G.CELL) -> DataFrame:
    """points(obs, pid, px, py) with hit, the struct of the element on top, or null. elements(obs, id, ord, end, rect): later ones are painted over earlier ones; a rectangle holds its left and upper edges.

    Each element lies in the cells that it touches and each point in one, so they meet by cell; the maximum is taken before anything is kept.
    """
    r = F.col("rect")
    span = lambda at, size: F.sequence(F.floor(r[at] / cell), F.greatest(F.floor(r[at] / cell), F.ceil((r[at] + r[size]) / cell) - 1))
    shown = elements.where((r["w"] > 0) & (r["h"] > 0)).select("obs", "id", "ord", "end", "rect", F.explode(span("x", "w")).alias("cx")).select("*", F.explode(span("y", "h")).alias("cy"))
    asked = points.select("obs", "pid", "px", "py", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy"))
    over = (F.col("px") >= r["x"]) & (F.col("px") < r["x"] + r["w"]) & (F.col("py") >= r["y"]) & (F.col("py") < r["y"] + r["h"])
    best = asked.join(shown, ["obs", "cx", "cy"]).where(over).groupBy("obs", "pid").agg(F.max(F.struct("ord", "id", "end")).alias("hit"))
    return points.join(best, ["obs", "pid"], "left")


def in_viewport(rect: Column, w: Column, h: Column, margin: int = MARGIN) -> Column:
    """Does a rectangle touch the viewport or a margin around it?"""
    return (rect["x"] + rect["w"] >= -margin) & (rect["y"] + rect["h"] >= -margin) & (rect["x"] <= w + margin) & (rect["y"] <= h + margin)


def occluded(elements: DataFrame, inset: int = INSET, cell: int = G.CELL) -> DataFrame:
    """(obs, id, occluded): an element is hidden if neither its centre nor a corner, taken inset, reaches it, something inside it or something that holds it. elements(obs, id, ord, end, rect): ord is
    the place in the document, end that of its last descendant (its own, if none). Without an area it is hidden. A row for each id; elements that are given twice count once.

    Rows are moved once, by page; cells, which settle the points in them, and ids are then grouped where they are. An element lies in the cells that it touches and in those of its points.
    """
    at = lambda v: F.floor(v / cell)

    def points(r: Column) -> Column:
        x, y, w, h = (r[k] for k in "xywh")
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x + w / 2, y + h / 2), (x + inset, y + inset), (x + w - inset, y + inset), (x + inset, y + h - inset), (x + w - inset, y + h - inset))])

    def cells(r: Column) -> Column:
        span = lambda k, n: F.sequence(at(r[k]), F.greatest(at(r[k]), F.ceil((r[k] + r[n]) / cell) - 1))
        place = lambda cx, cy: F.struct(cx.alias("cx"), cy.alias("cy"))
        touched = F.flatten(F.transform(span("x", "w"), lambda cx: F.transform(span("y", "h"), lambda cy: place(cx, cy))))
        return F.array_union(touched, F.transform(points(r), lambda p: place(at(p["x"]), at(p["y"]))))

    r = F.col("rect")
    rows = elements.select("obs", "id", "ord", "end", "rect").repartition("obs")
    # those without an area lie in no cell and hide nothing
    rows = rows.select("*", F.explode_outer(F.when((r["w"] > 0) & (r["h"] > 0), cells(r))).alias("c"))
    groups = rows.groupBy("obs", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(F.collect_list(F.struct("ord", "id", "end", "rect")).alias("all"))
    holds = lambda a, b: (a["ord"] <= b["ord"]) & (b["ord"] <= a["end"])
    over = lambda p: lambda e: (p["x"] >= e["rect"]["x"]) & (p["x"] < e["rect"]["x"] + e["rect"]["w"]) & (p["y"] >= e["rect"]["y"]) & (p["y"] < e["rect"]["y"] + e["rect"]["h"])
    top = lambda p: F.array_max(F.transform(F.filter("all", over(p)), lambda e: F.struct(e["ord"].alias("ord"), e["id"].alias("id"), e["end"].alias("end"))))
    reached = lambda e: lambda p: let(top(p), lambda hit: F.coalesce(holds(hit, e) | holds(e, hit), F.lit(False)))
    here = lambda p: (at(p["x"]) == F.col("cx")) & (at(p["y"]) == F.col("cy"))
    seen = lambda e: F.struct(e["id"].alias("id"), F.exists(F.filter(points(e["rect"]), here), reached(e)).alias("seen"))
    told = F.when(F.col("cx").isNull(), F.transform("all", lambda e: F.struct(e["id"].alias("id"), F.lit(False).alias("seen")))).otherwise(F.transform("all", seen))
    return groups.select("obs", F.explode(told).alias("s")).groupBy("obs", F.col("s.id").alias("id")).agg((~F.bool_or(F.coalesce("s.seen", F.lit(False)))).alias("occluded"))
