"""Near points and day ranges against plain readings."""

import datetime
import random

from hubmetrics.plans import ordered
from hubmetrics.plans.near import near_names


def groups(points, tolerance):
    """Connected groups by comparing all pairs."""
    left, out = set(points), set()
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            p = todo.pop()
            seen.add(p)
            near = {q for q in left if q[0] == p[0] and abs(q[1] - p[1]) < tolerance and abs(q[2] - p[2]) < tolerance}
            left -= near
            todo += near
        out.add(frozenset(seen))
    return out


def test_near_points_share_a_name(spark):
    random.seed(2)
    points = [(random.choice(["a", None]), random.randint(-400, 400) / 100, random.randint(-400, 400) / 100) for _ in range(160)]
    points += [("a", 0.49, 0.49), ("a", 0.51, 0.51), ("a", 7.0, 7.0), ("a", 7.0, 7.0), ("b", 9.99, 0.01), ("b", 10.01, -0.01), ("b", 10.99, -0.99)]
    df = spark.createDataFrame([*points, ("a", None, 1.0)], "k string, lon double, lat double")
    got = {}
    for r in near_names(df, ["k"], 0.25, "name").collect():
        got.setdefault(r.name, set()).add((None if "null" in r.group else r.group[6:7], r.lon, r.lat))
    assert {frozenset(g) for g in got.values()} == groups(set(points), 0.25)
    assert near_names(df.limit(0), ["k"], 0.25, "name").count() == 0


def test_means_over_days_cross_slices(spark):
    random.seed(3)
    start = datetime.date(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(random.randint(0, 400)), random.choice([None, 1, 2, 5])) for k in ["hot"] * 9 + ["b", None] for _ in range(40)]
    rows += [("one", start, 3), ("one", start, 5), ("one", None, 7)]
    got = ordered.with_day_ranges(spark.createDataFrame(rows, "k string, d date, v bigint"), ["k"], "d", "v", {"week": 7, "long": 90}).collect()
    want = set()
    for k, d in {(k, d) for k, d, _ in rows if d}:
        of = lambda n: [v for a, b, v in rows if a == k and b and v is not None and datetime.timedelta(0) <= d - b <= datetime.timedelta(n)]  # noqa: B023, E731
        mean = lambda x: sum(x) / len(x) if x else None
        own = [v for a, b, v in rows if a == k and b == d and v is not None]
        want.add((k, d, sum(own) if own else None, len(own), mean(of(7)), mean(of(90))))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_unique_days_are_not_added_up_again(spark):
    start = datetime.date(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(d), v) for k in ("a", None) for d, v in ((0, 4), (3, None), (9, 1), (40, 7))] + [("a", None, 5)]
    df = spark.createDataFrame(rows, "k string, d date, v bigint")
    got = [ordered.with_day_ranges(df, ["k"], "d", "v", {"week": 7, "long": 90}, unique=u) for u in (True, False)]
    assert {tuple(r) for r in got[0].collect()} == {tuple(r) for r in got[1].collect()} and got[0].count() == 8
    assert got[0].dtypes == got[1].dtypes
