"""Drawing shared segments line by line and joining them into long paths.

Paths are found without walking: at every vertex the segment ends of a group are paired in order of segment id, and the
chains that these links form are ranked by pointer doubling, which takes as many rounds as the logarithm of the longest
chain. No step brings a whole group or a whole path into one task.

Pieces are written once, numbered in order of their names. All steps work on these numbers: an end is twice its piece's
number, plus one for the side where the piece ends. Names come back in the last join. Most vertices join two ends, which the
cells' aggregates tell, so only the ends of vertices with three or more are put in order one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions.geo import offset_px
from hubmetrics.functions.lines import canonical_order, string_array
from hubmetrics.plans.connected import follow, hooks
from hubmetrics.plans.near import cell_box, cell_place, group_text, near_cells
from hubmetrics.plans.ordered import with_position
from hubmetrics.storage import lookup_table, materialize

GROUP = ["line", "offset_px", "is_loop", "corridor"]


def explode_lines(
    segments: DataFrame, active: Sequence[str], canonical: Sequence[str] = rules.LINE_ORDER,
    step: float = rules.OFFSET_STEP, loop_step: float = rules.LOOP_OFFSET_STEP,
) -> DataFrame:
    """One row per segment and active line, in canonical order, with the offset beside the other lines."""
    shown = canonical_order(F.array_intersect("lines", string_array(active)), canonical)
    others = [c for c in segments.columns if c != "lines"]
    listed = segments.withColumn("_shown", shown).withColumn("shared_count", F.size("_shown"))
    exploded = listed.select(*others, "shared_count", F.posexplode("_shown").alias("shared_index", "line"))
    return exploded.withColumn(
        "offset_px", offset_px(F.col("shared_index"), F.col("shared_count"), F.col("is_loop"), step, loop_step)
    )


def features_per_line(features: DataFrame) -> DataFrame:
    return features.groupBy("line").agg(F.count(F.lit(1)).alias("n_features"))


def features_per_count(features: DataFrame) -> DataFrame:
    return features.groupBy("segment_count").agg(F.count(F.lit(1)).alias("n_features"))


def lost_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines that had features before and have none after."""
    return features_per_line(before).join(after.select("line").distinct(), "line", "left_anti")


def line_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """``line, n_before, n_after, lost``: features of each line before and after a step, and whether it has none left."""
    counts = features_per_line(before).withColumnRenamed("n_features", "n_before").join(
        features_per_line(after).withColumnRenamed("n_features", "n_after"), "line", "full_outer")
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_before", "n_after")}
    return counts.select("line", *n.values(), (F.col("n_before").isNotNull() & F.col("n_after").isNull()).alias("lost"))


def _pieces(exploded: DataFrame) -> DataFrame:
    """Written segments with a name of their own, unique over all lines, and ``_id``, a number in the names' order.

    A segment id occurs once per line. Partitions follow the order of the names, and so do the numbers.
    """
    named = exploded.withColumn("piece", F.concat_ws("\u001f", "segment_id", "line"))
    ranged = named.repartitionByRange("piece").sortWithinPartitions("piece")
    return materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "pieces")


def piece_of(end: str) -> Column:
    return F.shiftright(end, 1)


def other_side(end: str) -> Column:
    return F.col(end).bitwiseXOR(F.lit(1).cast("bigint"))


def placed_ends(pieces: DataFrame) -> DataFrame:
    """``group, i, j, lon, lat, end``: two rows per piece, each in its cell; ends without a place are left out.

    The group is a digest of 128 bits of its columns.
    """
    sides = F.inline(F.array(*[
        F.struct((F.col("_id") * 2 + side).alias("end"), F.col(f"{p}.lon").alias("lon"), F.col(f"{p}.lat").alias("lat"))
        for side, p in enumerate(("p1", "p2"))]))
    ends = pieces.select(F.unhex(F.md5(group_text(GROUP))).alias("group"), sides)
    return ends.where("lon IS NOT NULL AND lat IS NOT NULL").withColumns(cell_place(rules.VERTEX_TOLERANCE))


def end_cells(ends: DataFrame) -> DataFrame:
    """Written cells of the tolerance's size with the number of ends in them, the first and the last, and their box."""
    cells = ends.groupBy("group", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.min("end").alias("first"), F.max("end").alias("last"), *cell_box())
    return materialize(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")


def end_links(pieces: DataFrame) -> DataFrame:
    """``a, b``: which ends continue in which: the first with the second at a vertex, the third with the fourth, and so on."""
    ends = placed_ends(pieces)
    cells = end_cells(ends)
    near = materialize(near_cells(cells, ends, rules.VERTEX_TOLERANCE, "cell"), "near")
    cells = cells.select("group", "i", "j", "cell", "n", "first", "last")
    # Cells that share their vertex with others; there may be none.
    both = near.select(F.col("u").alias("cell")).union(near.select("v")).distinct()
    named = lookup_table(follow(both.withColumn("vertex", F.col("cell")), "vertex", hooks(near)), "shared")
    shared = cells.join(named, "cell")
    totals = lookup_table(shared.groupBy("vertex").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")), "totals")
    alone = cells.join(named, "cell", "left_anti").withColumn("vertex", F.col("cell"))
    pairs = alone.select("n", "first", "last").unionByName(totals.select("n", "first", "last")).where(F.col("n") == 2)
    crowded = alone.where("n > 2").select("group", "i", "j", "vertex").unionByName(
        shared.select("group", "i", "j", "vertex").join(totals.where("n > 2").select("vertex"), "vertex", "left_semi").select("group", "i", "j", "vertex"))
    listed = materialize(ends.join(lookup_table(crowded, "crowded"), ["group", "i", "j"]).select("vertex", "end"), "listed")
    placed = with_position(listed, ["vertex"], [F.col("end").asc()])
    more = placed.groupBy("vertex", F.ceil(F.col("position") / 2).alias("_pair")).agg(
        F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 2)
    return pairs.select(F.col("first").alias("a"), F.col("last").alias("b")).unionByName(more.select("a", "b"))


def _arcs(links: DataFrame) -> DataFrame:
    """``node, nxt``: leaving a piece through the end ``node`` one comes to another piece and leaves that through ``nxt``."""
    return links.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), other_side("b").alias("nxt")),
        F.struct(F.col("b").alias("node"), other_side("a").alias("nxt")))))


def _rank_chains(arcs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """For every node of a chain of two or more: its last node, ``tail``, and the steps to it.

    Nodes on a ring have no last node; they are returned apart, with the least piece of their ring.
    """
    # ``low`` covers the pieces passed so far, ``later`` the same without the node's own.
    state = materialize(
        arcs.select("node", "nxt", F.col("nxt").alias("tail"), F.lit(1).cast("bigint").alias("steps"), piece_of("node").alias("low"),
                    F.lit(None).cast("bigint").alias("later")), "chains")
    finished, rings = [], []
    is_moving, moving_any = F.col("nxt").isNotNull(), F.coalesce(F.max(F.col("nxt").isNotNull()), F.lit(False))
    # A node that meets itself again and is the least on the way tells that its ring has been passed in full.
    met_itself = F.coalesce(is_moving & (F.col("later") == piece_of("node")), F.lit(False))
    going, start = state.agg(moving_any).first()[0], True
    while going:
        if not start:
            finished.append(state.where(~is_moving))
        ahead = _union([
            s.select(
                F.col("node").alias("nxt"), F.lit(True).alias("_found"), F.col("nxt").alias("_nxt"), F.col("tail").alias("_tail"),
                F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("later").alias("_later"))
            for s in [state, *finished[:-1]]
        ])
        # A next node without a row of its own is the last one of its chain.
        moved = state.where(is_moving).join(ahead, "nxt", "left").select(
            "node", F.col("_nxt").alias("nxt"), F.coalesce("_tail", "tail").alias("tail"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.least("low", F.coalesce("_low", piece_of("nxt"))).alias("low"),
            F.least("later", F.coalesce("_low", piece_of("nxt")), "_later").alias("later"), F.col("_found").isNull().alias("_last"))
        state = materialize(moved if start else moved.drop("_last"), "chains")
        if start:
            last = state.where("_last").select(
                F.col("tail").alias("node"), F.lit(None).cast("bigint").alias("nxt"), "tail", F.lit(0).cast("bigint").alias("steps"),
                piece_of("tail").alias("low"), F.lit(None).cast("bigint").alias("later"))
            finished, state, start = [last], state.drop("_last"), False
        going, ring_passed = state.agg(moving_any, F.coalesce(F.max(met_itself), F.lit(False))).first()
        if ring_passed:
            leaders = state.where(met_itself).select("low").distinct()
            passed = state.where(is_moving).join(leaders, "low", "left_semi")
            rings.append(passed.select("node", F.col("low").alias("leader")))
            state = materialize(state.join(rings[-1].select("node"), "node", "left_anti"), "chains")
            going = state.agg(moving_any).first()[0]
    finished.append(state)
    return _union(finished).select("node", "tail", "steps"), _union(rings)


def _union(parts: Sequence[DataFrame]) -> DataFrame | None:
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def stitch_order(exploded: DataFrame) -> DataFrame:
    """Each segment of each line with ``path_id, position, reversed, path_size``.

    Every segment belongs to exactly one path. The least piece of a path runs in its stored direction.
    """
    pieces = _pieces(exploded)
    arcs = materialize(_arcs(end_links(pieces)), "arcs")
    chains, rings = _rank_chains(arcs)
    if rings is not None and not rings.isEmpty():
        rings = materialize(rings, "rings")
        # A ring is opened where its least piece starts; what is left is a chain.
        leaders = lookup_table(rings.select((F.col("leader") * 2).alias("node")).distinct(), "leaders")
        at_start = arcs.join(leaders, "node", "left_semi")
        cut = materialize(at_start.select("node").unionByName(at_start.select(other_side("nxt").alias("node"))), "cut")
        open_arcs = arcs.join(rings.select("node"), "node", "left_semi").join(cut, "node", "left_anti")
        chains = chains.unionByName(_rank_chains(open_arcs)[0])
    chains = materialize(chains, "ranked")
    # Of the two directions keep the one in which the least piece leaves through its end.
    chosen = chains.groupBy("tail").agg(F.min("node").alias("_least"), (F.max("steps") + 1).alias("path_size")).where(
        F.col("_least") % 2 == 1)
    names = pieces.select(F.col("_id").alias("_path"), F.col("piece").alias("path_id"))
    chosen = lookup_table(chosen.withColumn("_path", piece_of("_least")).join(names, "_path").select("tail", "path_size", "path_id"), "chosen")
    ordered = chains.join(chosen, "tail").select(
        piece_of("node").alias("_id"), "path_id", "path_size", (F.col("path_size") - F.col("steps")).alias("position"),
        (F.col("node") % 2 == 0).alias("reversed"))
    # Pieces that are linked with none are paths of their own.
    one = F.lit(1).cast("bigint")
    return pieces.join(materialize(ordered, "ordered"), "_id", "left").withColumns({
        "path_id": F.coalesce("path_id", "piece"), "path_size": F.coalesce("path_size", one), "position": F.coalesce("position", one),
        "reversed": F.coalesce("reversed", F.lit(False))}).drop("_id", "piece")


def stitched_features(ordered: DataFrame, max_segments: int | None = None) -> DataFrame:
    """One row per path with its points; the properties are those of its least segment.

    A path is one row, however long; ``stitch_order`` has the same path as one row per segment. A caller who gives
    ``max_segments`` gets longer paths as several features that share their joints, numbered by ``part``.
    """
    start = F.when(F.col("reversed"), F.col("p2")).otherwise(F.col("p1"))
    end = F.when(F.col("reversed"), F.col("p1")).otherwise(F.col("p2"))
    part = (F.lit(0).cast("bigint") if max_segments is None else F.floor((F.col("position") - 1) / max_segments)).alias("part")
    steps = F.array_sort(F.collect_list(F.struct("position", start.alias("start"), end.alias("end"))))
    least = F.min(F.struct("segment_id", "shared_count", "shared_index"))
    merged = ordered.groupBy("path_id", *GROUP, part).agg(
        steps.alias("_steps"), least.alias("_least"), F.count(F.lit(1)).alias("segment_count")
    )
    points = F.concat(F.array(F.get("_steps", 0)["start"]), F.transform("_steps", lambda s: s["end"]))
    return merged.select(
        "path_id", "part", F.col("_least.segment_id").alias("segment_id"), *GROUP, F.col("_least.shared_count").alias("shared_count"),
        F.col("_least.shared_index").alias("shared_index"), "segment_count", points.alias("points"),
    )


def stitch(exploded: DataFrame, only_loop: bool = True, max_segments: int | None = None) -> DataFrame:
    """Stitched features; segments outside the loop pass through unchanged unless ``only_loop`` is off."""
    if not only_loop:
        return stitched_features(stitch_order(exploded), max_segments)
    single = exploded.where(~F.col("is_loop")).select(
        F.concat_ws("\u001f", "segment_id", "line").alias("path_id"), F.lit(0).cast("bigint").alias("part"), "segment_id",
        *GROUP, "shared_count", "shared_index", F.lit(1).cast("bigint").alias("segment_count"), F.array("p1", "p2").alias("points"),
    )
    looped = stitched_features(stitch_order(exploded.where("is_loop")), max_segments)
    return single.unionByName(looped)


def piece_links(pieces: DataFrame) -> DataFrame:
    """``u, v``: pieces that meet: each one at a vertex with the first of its cell, and the first ones of cells near each other."""
    ends = placed_ends(pieces)
    cells = end_cells(ends)
    near = near_cells(cells, ends, rules.VERTEX_TOLERANCE, "first")
    pairs = cells.where("n = 2").select(F.col("first").alias("u"), F.col("last").alias("v"))
    crowded = lookup_table(cells.where("n > 2").select("group", "i", "j", "first"), "crowded")
    more = ends.join(crowded, ["group", "i", "j"]).select(F.col("first").alias("u"), F.col("end").alias("v"))
    met = near.unionByName(pairs).unionByName(more)
    return met.select(piece_of("u").alias("u"), piece_of("v").alias("v"))


def components(exploded: DataFrame) -> DataFrame:
    """Each piece with ``component``, the least piece it is connected to within its group."""
    pieces = _pieces(exploded.select("segment_id", *GROUP, "p1", "p2"))
    rounds = hooks(piece_links(pieces))
    numbered = pieces.select(*GROUP, "piece", "_id")
    if not rounds:
        return numbered.drop("_id").withColumn("component", F.col("piece"))
    # Numbers follow the names' order, so the least number is that of the least name. The first round has all linked pieces.
    linked = materialize(follow(rounds[0].select(F.col("u").alias("_id"), F.col("u").alias("_least")), "_least", rounds), "linked")
    names = pieces.select(F.col("_id").alias("_least"), F.col("piece").alias("component"))
    named = lookup_table(linked.where("_id <> _least").join(names, "_least").select("_id", "component"), "components")
    return numbered.join(named, "_id", "left").withColumn("component", F.coalesce("component", "piece")).drop("_id")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*GROUP, "component").agg(F.count(F.lit(1)).alias("n_segments"))


def path_sizes(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("path_id", *GROUP).agg(F.count(F.lit(1)).alias("segment_count"))
