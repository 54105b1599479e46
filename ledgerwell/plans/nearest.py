"""The k nearest points of a few dimensions, by search over nested cells.

Cells quarter their width level by level. A cell knows how many points of each group it holds and the
box around them, which bounds every distance into it from below and above. A point first looks at
the smallest of its own cells that holds k others: their exact distances are a first bound. Then
cells are opened level by level, full ones only; a cell stays while its nearest corner is within
the bound, and the bound falls as the cells known to hold k points get smaller. Points are compared
one by one only in the cells that are left. Every join is on a cell, so work follows the
neighbourhood of a point and not the table.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import snapshot

DEPTH = 16              # halvings of the whole extent
STEP = 2                # halvings from one level to the next
LEAF = 64               # cells with at most so many points are not opened


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def euclid(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(_total([F.pow(x - y, F.lit(2.0)) for x, y in zip(a, b)]))


def nearest(points: DataFrame, dims: list[str], group: str, key: list[str], k: int, same_group: bool) -> DataFrame:
    """For every point the k nearest of its own group, or of all other groups: ``id`` and ``other``
    (structs of ``key`` and ``group``), ``distance`` and ``rank``. Ties go by ``key``, then group.
    A point with a null dimension or group takes no part; ``key`` names a point within its group. Copies of
    one place are cut to as many as a rank can need before any comparison."""
    at = [f"x{i}" for i in range(len(dims))]
    p = snapshot(points.dropna(subset=[*dims, group]).select(
        F.struct(*key, F.col(group).alias("group")).alias("id"), F.col(group).alias("group"),
        *[F.col(d).cast("double").alias(x) for d, x in zip(dims, at)]), "points")
    ends = p.agg(*[F.min(x).alias("a" + x) for x in at], *[F.max(x).alias("b" + x) for x in at]).first()
    low = [ends["a" + x] or 0.0 for x in at]
    extent = max([(ends["b" + x] or 0.0) - lo for x, lo in zip(at, low)]) * (1 + 1e-9) or 1.0
    scale = F.pow(F.lit(2.0), F.col("depth"))
    cell = F.struct("depth", *[F.floor((F.col(x) - lo) / extent * scale).alias("c" + x) for x, lo in zip(at, low)])
    above = F.struct((F.col("cell.depth") - STEP).alias("depth"), *[F.shiftright(f"cell.c{x}", STEP).alias("c" + x) for x in at])

    copies = Window.partitionBy(*at, "group").orderBy("id")
    kept = p.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + same_group).drop("_copy")
    others = snapshot(kept.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH), F.lit(STEP)))).withColumn("cell", cell)
                      .select("cell", F.col("group").alias("of"), F.col("id").alias("other"), *[F.col(x).alias("o" + x) for x in at]), "cells")
    bounds = [F.min("o" + x).alias("lo" + x) for x in at] + [F.max("o" + x).alias("hi" + x) for x in at]
    groups = snapshot(others.groupBy("cell", "of").agg(F.count("*").alias("n"), *bounds), "cell-groups")
    if same_group:
        wholes = groups.withColumn("n", F.col("n") - 1)                   # the point itself may be one of them
    else:
        wholes = snapshot(groups.groupBy("cell").agg(
            F.sum("n").alias("n"), *[F.min("lo" + x).alias("lo" + x) for x in at], *[F.max("hi" + x).alias("hi" + x) for x in at]), "cell-wholes")

    def eligible(rows: DataFrame, on: str = "cell") -> DataFrame:
        """Rows (point, ``on``) with the cells of that name or under it, and how many points there count for the point."""
        side = wholes if on == "cell" else wholes.withColumn("above", above)
        if same_group:
            return rows.join(side.withColumnRenamed("of", "group"), [on, "group"]).drop("above")
        own = groups.select("cell", F.col("of").alias("group"), F.col("n").alias("own"))
        got = rows.join(side, on).drop("above").join(own, ["cell", "group"], "left")
        return got.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).drop("own").filter("n > 0")

    def compared(rows: DataFrame) -> DataFrame:
        """The points of the cells, with exact distances and the k nearest ranked."""
        if same_group:
            cells = rows.withColumn("of", F.col("group"))
        else:
            cells = rows.join(groups.select("cell", "of"), "cell").filter("of <> group")
        pairs = (cells.select("id", *at, "bound", "cell", "of").join(others, ["cell", "of"]).filter("other <> id")
                 .withColumn("distance", euclid([F.col(x) for x in at], [F.col("o" + x) for x in at]))
                 .filter("bound IS NULL OR distance <= bound"))
        order = Window.partitionBy("id").orderBy("distance", "other")
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "other", "distance", "rank")

    place = ["id", "group", *at]
    own = p.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH), F.lit(STEP)))).select(*place, cell.alias("cell"))
    smallest = (eligible(own).filter(F.col("n") >= k).groupBy(*place)
                .agg(F.max(F.struct(F.col("cell.depth").alias("depth"), "cell", "n")).alias("s"))
                .filter(F.col("s.n") <= LEAF).select(*place, F.col("s.cell").alias("cell"), F.lit(None).cast("double").alias("bound")))
    first = compared(smallest).filter(F.col("rank") == k).select("id", F.col("distance").alias("bound"))
    rows = p.join(first, "id", "left").withColumn("depth", F.lit(0)).select(*place, "bound", cell.alias("cell"))

    near = F.sqrt(_total([F.pow(F.greatest(F.col("lo" + x) - F.col(x), F.col(x) - F.col("hi" + x), F.lit(0.0)), F.lit(2.0)) for x in at]))
    far = F.sqrt(_total([F.pow(F.greatest(F.col("hi" + x) - F.col(x), F.col(x) - F.col("lo" + x)), F.lit(2.0)) for x in at]))
    by_far = Window.partitionBy("id").orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    each = Window.partitionBy("id")
    slack = F.lit(1 + 1e-9)                                            # corners are rounded otherwise than points

    def within_bound(cells: DataFrame) -> DataFrame:
        held = (cells.withColumn("_near", near).withColumn("_far", far * slack)
                .filter("bound IS NULL OR _near <= bound * 1.000000001")
                .withColumn("_upto", F.sum("n").over(by_far))
                .withColumn("_sure", F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(each))
                .withColumn("bound", F.least("bound", "_sure")))
        return (held.filter("bound IS NULL OR _near <= bound * 1.000000001")
                .select(*place, "bound", "cell", "n"))

    boxed = [c for c in wholes.columns if c[:2] in ("lo", "hi")]
    frontier = snapshot(within_bound(eligible(rows)), "frontier")
    for depth in range(0, DEPTH, STEP):
        full = (F.col("cell.depth") == depth) & (F.col("n") > LEAF)
        opened = frontier.filter(full).drop("n")
        if opened.isEmpty():
            break
        children = eligible(opened.withColumnRenamed("cell", "above"), "above").select(*place, "bound", "cell", "n", *boxed)
        sizes = groups.select("cell", F.col("of").alias("group"), *boxed) if same_group else wholes.select("cell", *boxed)
        left = frontier.filter(~full).join(sizes, ["cell", "group"] if same_group else ["cell"]).select(*children.columns)
        frontier = snapshot(within_bound(left.unionByName(children)), "frontier")
    return compared(frontier)
