"""Simplification, shared segments, stitching and components against plain readings on small random data."""

import math
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.operators import simplify as S
from hubmetrics.operators import stitch as C
from hubmetrics.operators import tracks as T

POINTS = "route_id string, shape_id string, seq bigint, lon double, lat double"
PLACE = "struct<lon: double, lat: double>"
SEGMENT = f"segment_id string, corridor string, is_loop boolean, lines array<string>, p1 {PLACE}, p2 {PLACE}"
A, B, C_, D = (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)


def reference_simplify(points, tolerance):
    if len(points) <= 2:
        return points
    (x1, y1), (x2, y2) = points[0], points[-1]
    best, at = 0.0, 0
    for i, (x, y) in enumerate(points[1:-1], start=1):
        if (x1, y1) == (x2, y2):
            d = math.hypot(x - x1, y - y1)
        else:
            d = abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / math.hypot(y2 - y1, x2 - x1)
        if d > best:
            best, at = d, i
    if best <= tolerance:
        return [points[0], points[-1]]
    return reference_simplify(points[:at + 1], tolerance)[:-1] + reference_simplify(points[at:], tolerance)


@pytest.mark.parametrize("slice_points", [10_000, 40, 5, 1])
def test_simplify(spark, slice_points):
    rng = random.Random(3)
    shapes = {}
    for name, n in [("long", 400), ("mid", 30), ("two", 2), ("one", 1), ("ring", 60)]:
        x = y = 0.0
        walk = []
        for _ in range(n):
            x, y = x + rng.uniform(-1, 2), y + rng.gauss(0, 1)
            walk.append((x, y))
        if name == "ring":
            walk.append(walk[0])
        shapes[name] = walk
    rows = [("r", s, i * 3, *p) for s, walk in shapes.items() for i, p in enumerate(walk)]
    df = spark.createDataFrame(rows + rows[:50], POINTS).repartition(3)
    pairs = S.simplified_pairs(df, 1.5, slice_points)
    got = {}
    for r in S.simplified_points(pairs).orderBy("shape_id", "seq").collect():
        got.setdefault(r.shape_id, []).append((r.lon, r.lat))
    assert got == {s: reference_simplify(walk, 1.5) for s, walk in shapes.items() if len(walk) > 1}
    assert pairs.count() == sum(len(v) - 1 for v in got.values())


def test_straight_large_shape_keeps_only_its_ends(spark):
    df = spark.createDataFrame([("r", "s", i, float(i), 0.0) for i in range(200)], POINTS)
    got = S.simplified_points(S.simplified_pairs(df, 0.1, 10)).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 199]


def jobs_of(spark, work):
    """How many jobs Spark starts for some work."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_simplification_takes_no_more_passes_when_cuts_follow_one_another(spark):
    """Every cut of the first shape lies next to an end of its span; the second has none."""
    n = 300
    walks = {"comb": [(float(i), 3.0 ** -i * 1e9) for i in range(n)], "flat": [(float(i), 0.0) for i in range(n)]}
    jobs = {}
    for name, walk in walks.items():
        df = spark.createDataFrame([("r", name, i, *p) for i, p in enumerate(walk)], POINTS)
        got = []
        jobs[name] = jobs_of(spark, lambda: got.extend(S.simplified_points(S.simplified_pairs(df, 1e-6, 7)).orderBy("seq").collect()))
        assert [(r.lon, r.lat) for r in got] == reference_simplify(walk, 1e-6)
    assert jobs["comb"] == jobs["flat"]


def test_simplification_prefers_the_first_of_equally_far_points(spark):
    """Four equal peaks over a straight way, in different slices."""
    walk = [(float(i), 5.0 if i in (7, 23, 24, 39) else 0.0) for i in range(50)]
    df = spark.createDataFrame([("r", "s", i, *p) for i, p in enumerate(walk)], POINTS)
    for slice_points in (3, 8, 10_000):
        got = S.simplified_points(S.simplified_pairs(df, 0.5, slice_points)).orderBy("seq").collect()
        assert [(r.lon, r.lat) for r in got] == reference_simplify(walk, 0.5)


def test_simplification_leaves_out_points_without_shape_or_place(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("r", "s", 0, 0.0, 0.0), ("r", "s", 1, nan, 9.0), ("r", "s", 2, inf, 9.0), ("r", "s", 3, None, 9.0), ("r", "s", 4, 5.0, 5.0),
            ("r", "s", 4, 6.0, 5.0), ("r", "s", 5, 9.0, 0.0), (None, "s", 6, 1.0, 1.0), ("r", None, 7, 1.0, 1.0), (None, "s", 8, 2.0, 1.0)]
    df = spark.createDataFrame(rows, POINTS)
    got = S.simplified_points(S.simplified_pairs(df, 0.1)).orderBy("seq").collect()
    assert [(r.seq, r.lon, r.lat) for r in got] == [(0, 0.0, 0.0), (4, 5.0, 5.0), (5, 9.0, 0.0)]
    assert S.simplified_pairs(df.limit(0)).count() == 0


def test_box_bounds_hold_for_all_points_inside():
    rng = np.random.default_rng(5)
    for scale in (1e-9, 1e-3, 1.0, 1e4):
        for _ in range(200):
            x, y = -87.6 + scale * rng.normal(size=40), 41.9 + scale * rng.normal(size=40)
            chord = [-87.6 + scale * rng.normal(), 41.9 + scale * rng.normal()] * 2 if rng.random() < 0.2 else [
                v + scale * rng.normal() for v in (-87.6, 41.9, -87.6, 41.9)]
            bound = S._bounds(np.array([[x.min(), y.min(), x.max(), y.max()]]), *chord)[0]
            assert S._distance(x, y, *chord).max() <= bound


def test_shared_segments_do_not_depend_on_direction(spark):
    there, back = [(0, -87.7, 41.9), (1, -87.71, 41.91)], [(0, -87.71, 41.91), (1, -87.7, 41.9)]
    rows = [("Red", "a", *p) for p in there] + [("G", "b", *p) for p in back] + [("Nope", "c", *p) for p in there]
    got = T.shared_segments(T.polyline_pairs(spark.createDataFrame(rows, POINTS))).collect()
    assert len(got) == 1 and got[0].lines == ["Green", "Nope", "Red"] and got[0].corridor == "South Side"
    assert (tuple(got[0].p1), tuple(got[0].p2)) == ((-87.71, 41.91), (-87.7, 41.9))


def test_shapes_of_several_routes(spark):
    routes = spark.createDataFrame([("Red",), ("Bus",), ("P",)], "route_id string")
    trips = spark.createDataFrame([("Red", "s"), ("P", "s"), ("Bus", "s"), ("Red", "s"), ("Red", "")], "route_id string, shape_id string")
    points = spark.createDataFrame([("s", 1, 0.0, 0.0), ("t", 1, 0.0, 0.0)], "shape_id string, seq bigint, lon double, lat double")
    got = T.route_shapes(routes, trips, points, rules.TRACK_ROUTE_LINES).collect()
    assert {(r.route_id, r.shape_id) for r in got} == {("Red", "s"), ("P", "s")} and len(got) == 2


def test_bounding_box(spark):
    points = spark.createDataFrame([(-87.7, 41.9), (-87.5, 42.0), (-89.0, 42.0)], "lon double, lat double")
    assert tuple(T.bounding_box(points).first()) == (-89.0, 41.9, -87.5, 42.0, 0)
    assert T.bounding_box(points.where("lon > -88")).first().plausible == 1


def segments(spark, rows, lines=("Red",), is_loop=True):
    return spark.createDataFrame([(i, "Loop", is_loop, list(lines), p, q) for i, p, q in rows], SEGMENT)


def test_offsets(spark):
    lines = ["Purple", "Brown", "Pink", "Yellow"]
    wide = C.explode_lines(segments(spark, [("s", A, B)], lines, False), ["Brown", "Purple", "Pink"]).orderBy("shared_index").collect()
    assert [(r.line, r.offset_px, r.shared_count) for r in wide] == [("Brown", -3.5, 3), ("Purple", 0.0, 3), ("Pink", 3.5, 3)]
    loop = C.explode_lines(segments(spark, [("s", A, B)], lines), ["Brown", "Purple"]).orderBy("shared_index").collect()
    assert [r.offset_px for r in loop] == [-1.0, 1.0]
    assert C.explode_lines(segments(spark, [("s", A, B)], lines), ["Green"]).count() == 0


CASES = {
    "in line": ([("1", A, B), ("2", B, C_)], [[A, B, C_]]),
    "second reversed": ([("1", A, B), ("2", C_, B)], [[A, B, C_]]),
    "first in the middle": ([("1", B, A), ("2", B, C_)], [[C_, B, A]]),
    "apart": ([("1", A, B), ("2", C_, D)], [[A, B], [C_, D]]),
    "ring": ([("1", A, B), ("2", B, C_), ("3", D, C_), ("4", D, A)], [[A, B, C_, D, A]]),
    "fork": ([("1", A, B), ("2", B, C_), ("3", B, D)], [[A, B, C_], [B, D]]),
    "point": ([("1", A, A)], [[A, A]]),
}


@pytest.mark.parametrize("case", list(CASES))
def test_stitch_cases(spark, case):
    rows, paths = CASES[case]
    exploded = C.explode_lines(segments(spark, rows), ["Red"])
    got = C.stitch(exploded).orderBy("path_id").collect()
    assert [[tuple(p) for p in r.points] for r in got] == paths
    assert sum(r.segment_count for r in got) == len(rows)


def test_segments_outside_the_loop_pass_through(spark):
    exploded = C.explode_lines(segments(spark, CASES["in line"][0], is_loop=False), ["Red"])
    assert [r.segment_count for r in C.stitch(exploded).collect()] == [1, 1]
    assert [r.segment_count for r in C.stitch(exploded, only_loop=False).collect()] == [2]


def random_exploded(spark, seed, n, grid, lines=("Red", "Blue")):
    rng = random.Random(seed)
    place = lambda: (float(rng.randrange(grid)), float(rng.randrange(grid)))
    rows = [(f"{i:04}", "Loop", True, [rng.choice(lines)], place(), place()) for i in range(n)]
    return rows, C.explode_lines(spark.createDataFrame(rows, SEGMENT), list(lines))


@pytest.mark.parametrize("seed, n, grid", [(1, 60, 4), (2, 80, 12), (3, 40, 2)])
def test_stitch_uses_every_segment_once_and_paths_hang_together(spark, seed, n, grid):
    rows, exploded = random_exploded(spark, seed, n, grid)
    ordered = C.stitch_order(exploded).collect()
    assert Counter(r.segment_id for r in ordered) == Counter(r[0] for r in rows)
    paths = {}
    for r in sorted(ordered, key=lambda r: r.position):
        start, end = (r.p2, r.p1) if r.reversed else (r.p1, r.p2)
        paths.setdefault(r.path_id, []).append((r.segment_id, r.line, tuple(start), tuple(end), r.position, r.path_size, r.reversed))
    for steps in paths.values():
        assert [s[4] for s in steps] == list(range(1, len(steps) + 1)) and {s[5] for s in steps} == {len(steps)}
        assert len({s[1] for s in steps}) == 1
        assert all(a[3] == b[2] for a, b in zip(steps, steps[1:]))
        assert not min(steps)[6]
    # At most one end per line and vertex stays open.
    open_ends = Counter((s[0][1], v) for s in paths.values() for v in (s[0][2], s[-1][3]) if s[0][2] != s[-1][3])
    assert all(count == 1 for count in open_ends.values())


def test_long_path_comes_in_parts(spark):
    rows = [(f"{i:03}", (float(i), 0.0), (float(i + 1), 0.0)) for i in range(25)]
    exploded = C.explode_lines(segments(spark, rows), ["Red"])
    got = C.stitched_features(C.stitch_order(exploded), max_segments=10).orderBy("part").collect()
    assert [r.segment_count for r in got] == [10, 10, 5]
    assert got[0].points[-1] == got[1].points[0] and got[2].points[-1].lon == 25.0
    assert C.lost_lines(exploded, C.stitch(exploded)).count() == 0


@pytest.mark.parametrize("seed, n, grid", [(4, 80, 9), (5, 120, 30), (6, 30, 2)])
def test_components(spark, seed, n, grid):
    rows, exploded = random_exploded(spark, seed, n, grid)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, _, _, (line,), p, q in rows:
        for v in (p, q):
            parent[find((line, v))] = find((line, i))
    least = {}
    for i, _, _, (line,), _, _ in rows:
        root = find((line, i))
        least[root] = min(least.get(root, i), i)
    got = {r.piece.split("\u001f")[0]: r.component.split("\u001f")[0] for r in C.components(exploded).collect()}
    assert got == {i: least[find((line, i))] for i, _, _, (line,), _, _ in rows}
    sizes = C.component_sizes(C.components(exploded)).agg(F.sum("n_segments")).first()[0]
    assert sizes == n


def test_links_are_numbers_in_the_order_of_names(spark):
    """Names stay in the written pieces; what is shuffled and ranked are numbers. Four ends at one vertex make two pairs by name."""
    rows = [("b", B, A), ("a", A, C_), ("d", D, A), ("c", A, B)]
    pieces = C._pieces(C.explode_lines(segments(spark, rows), ["Red"]))
    number = {r._id: r.segment_id for r in pieces.collect()}
    assert [number[k] for k in sorted(number)] == ["a", "b", "c", "d"]
    links = C.end_links(pieces)
    assert {kind for _, kind in links.dtypes} == {"bigint"}
    got = {frozenset((number[e >> 1], e & 1) for e in r) for r in links.collect()}
    assert got == {frozenset({("a", 0), ("b", 1)}), frozenset({("c", 0), ("d", 1)}), frozenset({("b", 0), ("c", 1)})}
