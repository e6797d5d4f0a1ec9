"""One name for points that lie within a tolerance of each other, directly or through others, without comparing all pairs.

Points fall into square cells whose side is the tolerance. All points of a cell are near each other, so a cell is one node
however many points it holds. Cells side by side are near if the gap between their outermost points is below the tolerance, which
two aggregates tell. Only for cells that meet at a corner are points compared, and of these only the few that no other
point of the cell surpasses towards that corner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubmetrics.plans.connected import follow, hooks
from hubmetrics.storage import lookup_table, materialize

#: Strips that a cell is cut into before its outermost points are looked for, so that a crowded cell is not one task.
STRIPS = 16
#: Side of the blocks, in cells, that tell which cells have others nearby at all.
BLOCK = 64


def cell_place(tolerance: float) -> dict:
    """Columns ``i, j``: the cell that a point (lon, lat) falls into."""
    return {c: F.floor(F.col(p) / tolerance).cast("bigint") for c, p in (("i", "lon"), ("j", "lat"))}


def cell_box() -> list:
    """Aggregates ``west, east, south, north`` of the points of a cell."""
    return [F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north")]


def near_cells(cells: DataFrame, points: DataFrame, tolerance: float, value: str) -> DataFrame:
    """``u, v``: the values of each two neighbouring cells that hold points near each other.

    ``cells`` is written, with one row per (group, i, j), the cell's box and ``value``; ``points`` has group, i, j, lon, lat. A cell
    without another one in its block, or beyond the block's border right beside it, has no neighbour and is not looked at again.
    """
    k = F.lit(BLOCK)
    blocks = [F.array_distinct(F.array(*[F.floor((F.col(c) + d) / k) for d in (-1.0, 0.0, 1.0)])) for c in ("i", "j")]
    spread = cells.select("group", "i", "j", F.explode(blocks[0]).alias("_bi"), blocks[1].alias("_bjs")).select(
        "group", "i", "j", "_bi", F.explode("_bjs").alias("_bj"))
    crowded = spread.groupBy("group", "_bi", "_bj").agg(
        F.min("i").alias("_i0"), F.max("i").alias("_i1"), F.min("j").alias("_j0"), F.max("j").alias("_j1")
    ).where("_i0 < _i1 OR _j0 < _j1").select("group", "_bi", "_bj")
    crowded = lookup_table(crowded, "crowded")
    placed = cells.withColumns({"_bi": F.floor(F.col("i") / k), "_bj": F.floor(F.col("j") / k)})
    near = placed.join(crowded, ["group", "_bi", "_bj"], "left_semi").drop("_bi", "_bj")
    cells = materialize(near.select("group", "i", "j", "west", "east", "south", "north", F.col(value).alias("_value")), "close_cells")
    edges = _corner(points, cells, tolerance, 1).unionByName(_corner(points, cells, tolerance, -1))
    for across, up, first, second in ((1, 0, "east", "west"), (0, 1, "north", "south")):
        other = cells.select(
            "group", (F.col("i") - across).alias("i"), (F.col("j") - up).alias("j"), F.col(second).alias("_there"), F.col("_value").alias("v"))
        met = cells.join(other, ["group", "i", "j"]).where(F.col("_there") - F.col(first) < tolerance)
        edges = edges.unionByName(met.select(F.col("_value").alias("u"), "v"))
    return edges


def near_names(points: DataFrame, keys: Sequence[str], tolerance: float, name: str) -> DataFrame:
    """``group, lon, lat, name``: each distinct point of ``points`` (keys, lon, lat) and the name it shares with all that are near.

    Two points of the same keys (missing ones are equal) are near if both coordinates differ by less than ``tolerance``; nearness
    passes on. ``group`` is ``group_text`` of the keys. Points without a place are left out; no points give no rows.
    """
    placed = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(group_text(keys).alias("group"), "lon", "lat").distinct()
    placed = materialize(placed.withColumns(cell_place(tolerance)), "placed")
    cells = placed.groupBy("group", "i", "j").agg(*cell_box())
    cells = materialize(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    named = follow(cells.select("group", "i", "j", F.col("cell").alias(name)), name, hooks(near_cells(cells, placed, tolerance, "cell")))
    return placed.join(lookup_table(named, "named"), ["group", "i", "j"]).select("group", "lon", "lat", name)


def group_text(keys: Sequence[str]):
    """The keys as one text, missing ones included."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def _outermost(points: DataFrame, right: bool, up: bool) -> DataFrame:
    """Of each strip of a cell, the points that no other one surpasses both to that side and up (or down)."""
    best = F.max("lat") if up else F.min("lat")
    unique = points.groupBy("group", "i", "j", "_strip", "lon").agg(best.alias("lat"))  # before the sort, so repeated places are few
    before = Window.partitionBy("group", "i", "j", "_strip").orderBy(
        F.col("lon").desc() if right else F.col("lon").asc()).rowsBetween(Window.unboundedPreceding, -1)
    passed = best.over(before)
    kept = unique.withColumn("_passed", passed).where(
        F.col("_passed").isNull() | ((F.col("lat") > F.col("_passed")) if up else (F.col("lat") < F.col("_passed"))))
    return kept.select("group", "i", "j", "lon", "lat")


def _corner(points: DataFrame, cells: DataFrame, tolerance: float, up: int) -> DataFrame:
    """Edges from cells to their neighbours at the upper (1) or lower (-1) right corner."""
    there = cells.select("group", (F.col("i") - 1).alias("i"), (F.col("j") - up).alias("j"), F.col("_value").alias("v"))
    left = cells.select("group", "i", "j", F.col("_value").alias("u")).join(there, ["group", "i", "j"])
    left = materialize(left, "corners")
    right = left.select("group", (F.col("i") + 1).alias("i"), (F.col("j") + up).alias("j"))
    strip = F.floor((F.col("lon") / tolerance - F.col("i")) * STRIPS)
    cut = points.select("group", "i", "j", "lon", "lat", strip.alias("_strip"))
    mine = _outermost(cut.join(left, ["group", "i", "j"], "left_semi"), True, up > 0)
    theirs = _outermost(cut.join(right, ["group", "i", "j"], "left_semi"), False, up < 0).select(
        "group", (F.col("i") - 1).alias("i"), (F.col("j") - up).alias("j"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    met = mine.join(theirs, ["group", "i", "j"]).where(
        (F.abs(F.col("_lon") - F.col("lon")) < tolerance) & (F.abs(F.col("_lat") - F.col("lat")) < tolerance))
    return left.join(met.select("group", "i", "j").distinct(), ["group", "i", "j"], "left_semi").select("u", "v")
