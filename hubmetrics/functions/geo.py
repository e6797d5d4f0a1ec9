"""Geometry on (lon, lat) structs and the naming of shared segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubmetrics import rules


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def in_box(p: Column, box: Sequence[float] = rules.LOOP_BOX) -> Column:
    west, east, south, north = box
    return p["lon"].between(west, east) & p["lat"].between(south, north)


def snap_pair(p: Column, q: Column, box: Sequence[float] = rules.LOOP_BOX) -> tuple[Column, Column]:
    """Both points rounded to 4 decimals if both lie in the box, else to 5."""
    coarse = in_box(p, box) & in_box(q, box)

    def snap(x: Column) -> Column:
        # Adding zero turns -0.0 into 0.0, so that the text form is unique.
        return F.when(coarse, F.bround(x, 4)).otherwise(F.bround(x, 5)) + F.lit(0.0)

    return point(snap(p["lon"]), snap(p["lat"])), point(snap(q["lon"]), snap(q["lat"]))


def segment_key(p: Column, q: Column, box: Sequence[float] = rules.LOOP_BOX) -> Column:
    """The same text for (p, q) and (q, p): the lesser point first."""
    a, b = snap_pair(p, q, box)
    low, high = F.least(a, b), F.greatest(a, b)
    return F.format_string("%.5f,%.5f_%.5f,%.5f", low["lon"], low["lat"], high["lon"], high["lat"])


def haversine_m(p: Column, q: Column) -> Column:
    """Distance in metres on the sphere."""
    half_lat = F.radians(q["lat"] - p["lat"]) / 2
    half_lon = F.radians(q["lon"] - p["lon"]) / 2
    h = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(p["lat"])) * F.cos(F.radians(q["lat"])) * F.pow(
        F.sin(half_lon), F.lit(2)
    )
    return F.lit(2 * rules.EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def line_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of p from the line through a and b, or from a where both are the same point; in degrees."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    area = F.abs(dy * p["lon"] - dx * p["lat"] + b["lon"] * a["lat"] - b["lat"] * a["lon"])
    ex, ey = p["lon"] - a["lon"], p["lat"] - a["lat"]
    return F.when((dx == 0) & (dy == 0), F.sqrt(ex * ex + ey * ey)).otherwise(area / F.sqrt(dy * dy + dx * dx))


def vertex_key(p: Column) -> Column:
    """End points that agree to 6 decimals are one vertex."""
    return F.format_string("%.6f,%.6f", F.bround(p["lon"], 6) + F.lit(0.0), F.bround(p["lat"], 6) + F.lit(0.0))


def corridor(lines: Column, corridor_rules=rules.CORRIDOR_RULES) -> Column:
    """The corridor of a segment by its distinct lines: first rule that holds, else 'Shared', else the single line."""
    name = F.when(F.size(lines) > 1, F.lit("Shared")).otherwise(F.get(lines, 0))
    for kind, n, wanted, label in reversed(corridor_rules):
        common = F.size(F.array_intersect(lines, F.array(*[F.lit(x) for x in wanted])))
        holds = common >= n
        if kind == "equal":
            holds = holds & (F.size(lines) == n)
        name = F.when(holds, F.lit(label)).otherwise(name)
    return name


def length_bucket(metres: Column) -> Column:
    return (
        F.when(metres < 50, "0-50m").when(metres < 200, "50-200m").when(metres < 500, "200-500m")
        .when(metres < 1000, "500-1000m").otherwise("1000m+")
    )


def offset_px(index: Column, count: Column, is_loop: Column, step: float = rules.OFFSET_STEP,
              loop_step: float = rules.LOOP_OFFSET_STEP) -> Column:
    """Where a line runs beside the others on a shared segment, the middle being 0."""
    return (index - (count - F.lit(1)) / F.lit(2)) * F.when(is_loop, F.lit(loop_step)).otherwise(F.lit(step))
