"""From route shapes to shared track segments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions.geo import corridor, haversine_m, in_box, length_bucket, point, segment_key
from hubmetrics.functions.names import literal_map
from hubmetrics.plans.ordered import with_next, with_position
from hubmetrics.storage import lookup_table

SHAPE = ["route_id", "shape_id"]


def route_shapes(routes: DataFrame, trips: DataFrame, points: DataFrame, route_lines: Mapping[str, str]) -> DataFrame:
    """Points (route_id, shape_id, seq, lon, lat) of the routes with a line; a shape of two routes comes once for each."""
    wanted = routes.where(F.col("route_id").isin(list(route_lines))).select("route_id").distinct()
    used = (
        trips.where(F.coalesce("shape_id", F.lit("")) != "").select("route_id", "shape_id").distinct()
        .join(wanted, "route_id", "left_semi")
    )
    return points.join(lookup_table(used, "shapes"), "shape_id").select(*SHAPE, "seq", "lon", "lat")


def polyline_pairs(points: DataFrame) -> DataFrame:
    """Each point with the next one of its shape: ``p1, p2, metres, is_long``."""
    next_point = F.struct(F.col("seq"), F.col("lon"), F.col("lat"))
    paired = with_next(points, SHAPE, ["seq"], next_point, "_next").where(F.col("_next").isNotNull())
    return as_pairs(paired.select(
        *SHAPE, "seq", "lon", "lat",
        F.col("_next.seq").alias("next_seq"), F.col("_next.lon").alias("next_lon"), F.col("_next.lat").alias("next_lat"),
    ))


def as_pairs(rows: DataFrame) -> DataFrame:
    p1, p2 = point(F.col("lon"), F.col("lat")), point(F.col("next_lon"), F.col("next_lat"))
    return (
        rows.withColumns({"p1": p1, "p2": p2})
        .withColumn("metres", haversine_m(F.col("p1"), F.col("p2")))
        .withColumn("is_long", F.col("metres") > rules.LONG_SEGMENT_M)
        .select(*SHAPE, "seq", "next_seq", "p1", "p2", "metres", "is_long")
    )


def shared_segments(
    pairs: DataFrame, route_lines: Mapping[str, str] = rules.TRACK_ROUTE_LINES, corridor_rules=rules.CORRIDOR_RULES
) -> DataFrame:
    """One row per segment key: lines, corridor, end points of its last occurrence with the lesser point first.

    Lines that use the same segment many times are reduced to one row per (segment, line) first, so that the set of
    lines is collected from distinct values only.
    """
    keyed = pairs.select(
        segment_key(F.col("p1"), F.col("p2")).alias("segment_key"),
        F.coalesce(F.try_element_at(literal_map(route_lines), F.col("route_id")), F.col("route_id")).alias("line"),
        F.struct(*SHAPE, "seq").alias("_at"),
        F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"),
    )
    per_line = keyed.groupBy("segment_key", "line").agg(F.max(F.struct("_at", "p1", "p2")).alias("_last"))
    return (
        per_line.groupBy("segment_key")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"), F.max("_last").alias("_last"))
        .withColumn("corridor", corridor(F.col("lines"), corridor_rules))
        .select(
            "segment_key", "lines", "corridor", (F.col("corridor") == rules.LOOP_CORRIDOR).alias("is_loop"),
            F.col("_last.p1").alias("p1"), F.col("_last.p2").alias("p2"),
        )
    )


def number_segments(segments: DataFrame) -> DataFrame:
    """Add ``segment_id``: seg_0000 and on, in the order of the keys."""
    numbered = with_position(segments, [], [F.col("segment_key").asc()])
    segment_id = F.format_string("seg_%04d", F.col("position") - 1)
    return numbered.withColumn("segment_id", segment_id).select("segment_id", *segments.columns)


def bounding_box(points: DataFrame, plausible=rules.PLAUSIBLE_BOX) -> DataFrame:
    """West, south, east, north of all points, and whether they lie in the plausible box."""
    box = points.agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")
    )
    corners = [point(F.col(f"{c}_lon"), F.col(f"{c}_lat")) for c in ("min", "max")]
    return box.withColumn("plausible", (in_box(corners[0], plausible) & in_box(corners[1], plausible)).cast("int"))


def segment_ends(segments: DataFrame) -> DataFrame:
    return segments.select(F.inline(F.array("p1", "p2")))


def length_histogram(segments: DataFrame) -> DataFrame:
    metres = haversine_m(F.col("p1"), F.col("p2"))
    return segments.groupBy(length_bucket(metres).alias("bucket")).agg(F.count(F.lit(1)).alias("n_segments"))


def sharing_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy(F.size("lines").alias("n_lines")).agg(F.count(F.lit(1)).alias("n_segments"))


def sample_segments(segments: DataFrame, k: int = 5, shared_only: bool = False) -> DataFrame:
    if shared_only:
        segments = segments.where(F.size("lines") > 1)
    return segments.orderBy("segment_key").limit(k)


def code_line(code: Column, route_lines: Mapping[str, str] = rules.ROUTE_LINES) -> Column:
    """The line of a route code; an unknown code stands for itself."""
    return F.coalesce(F.try_element_at(literal_map(route_lines), code), code)
