"""Metrics, scores, upserts and pruning on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.operators import maintain as U
from hubmetrics.operators import metrics as M
from hubmetrics.operators import score as S
from hubmetrics.operators import serve as V

STATION = "station_id string, city_code string, name string"
FACT = "station_id string, service_date date, entries bigint"


def day(text):
    return datetime.date.fromisoformat(text)


def facts(spark, *rows):
    return spark.createDataFrame([(s, day(d), n) for s, d, n in rows], FACT)


def stations(spark, *ids, city="x"):
    return spark.createDataFrame([(i, city, f"Station {i}") for i in ids], STATION)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_windows_include_their_bounds(spark):
    data = facts(spark, ("a", "2024-03-31", 10), ("a", "2024-03-01", 20), ("a", "2024-02-29", 1000), ("b", "2024-01-01", 7),
                 ("b", "2023-12-31", 9))
    got = {r.station_id: r for r in M.station_metrics(stations(spark, "a", "b", "c"), data).collect()}
    assert (got["a"].rolling_30d_avg, got["a"].ridership_rows, got["a"].max_entries, got["a"].last_day_entries) == (15.0, 3, 1000, 10)
    assert (got["b"].rolling_30d_avg, got["b"].rolling_90d_avg, got["b"].data_status) == (0.0, 7.0, "normal")
    assert (got["c"].data_status, got["c"].rolling_30d_avg, got["c"].service_date_max) == ("missing", 0.0, None)


def test_scopes_and_as_of(spark):
    both = stations(spark, "a").unionByName(stations(spark, "b", city="y"))
    data = facts(spark, ("a", "2024-03-31", 10), ("b", "2024-01-31", 30), ("b", "2024-01-01", 10))
    averages = {}
    for name, options in {"city": {}, "global": {"scope": "global"}, "as_of": {"as_of": day("2024-01-15")}}.items():
        got = {r.station_id: r for r in M.station_metrics(both, data, **options).collect()}
        averages[name] = (got["a"].rolling_30d_avg, got["b"].rolling_30d_avg)
    assert averages == {"city": (10.0, 20.0), "global": (10.0, 0.0), "as_of": (0.0, 10.0)}


@pytest.mark.parametrize("n, first, middle, last", [(1, 0, 0, 0), (2, 50, 50, 0), (3, 66, 33, 0), (4, 75, 50, 0), (20, 95, 50, 0),
                                                   (100, 99, 50, 0), (143, 99, 49, 0)])
def test_score_table(spark, n, first, middle, last):
    metrics = spark.createDataFrame([(f"{i:03}", "x", float(i), "normal") for i in range(n)] + [("zz", "x", 0.0, "missing")],
                                    "station_id string, city_code string, rolling_30d_avg double, data_status string")
    scored = [r.score for r in S.low_use_score(metrics).orderBy("station_id").collect()]
    assert (scored[0], scored[(n + 1) // 2 - 1], scored[n - 1], scored[-1]) == (first, middle, last, -1)
    assert scored[:n] == sorted(scored[:n], reverse=True) and all(0 <= s <= 99 for s in scored[:n])
    if n in (20, 100):
        assert scored[{20: 10, 100: 54}[n]] == 44


def test_equal_ties(spark):
    metrics = spark.createDataFrame([(str(i), "x", v, "normal") for i, v in enumerate([1.0, 1.0, 2.0, 2.0])],
                                    "station_id string, city_code string, rolling_30d_avg double, data_status string")
    assert [r.score for r in S.low_use_score(metrics, equal_ties=True).orderBy("station_id").collect()] == [50, 50, 0, 0]


def test_percentile_counts_lower_stations(spark):
    metrics = spark.createDataFrame([(str(i), "x", v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0, None])],
                                    "station_id string, city_code string, rolling_30d_avg double")
    got = [r.percentile for r in S.percentiles(metrics).orderBy("station_id").collect()]
    assert got == [0, 13, 13, 38, 50, 63, 75, 100]


def test_lists(spark):
    table = stations(spark, "a", "b", "c")
    metrics = spark.createDataFrame([("a", "x", "A", 10, 5.0, 3, None), ("b", "x", "B", -1, 0.0, 0, None)],
                                    "station_id string, city_code string, name string, score int, rolling_30d_avg double, last_day_entries bigint, service_date_max date")
    order = lambda sort: [r.station_id for r in V.station_list(table, metrics, sort).orderBy("list_rank").collect()]
    assert order("score_desc") == order("anything else") == ["a", "c", "b"] and order("score_asc") == ["b", "c", "a"]
    assert [r.station_id for r in V.raw_station_list(table, metrics, "score_asc").collect()] == ["c", "b", "a"]
    mixed = stations(spark, "1", "2", "3").withColumn("name", F.element_at(F.array(F.lit("b"), F.lit("C"), F.lit("ä")), F.col("station_id").cast("int")))
    named = lambda collation: [r.station_id for r in V.station_list(mixed, metrics, "name", collation=collation).orderBy("list_rank").collect()]
    assert named(None) == ["2", "1", "3"] and named("UNICODE") == ["3", "1", "2"]
    assert V.find_station(table, "a", "y").count() == 0 and V.find_station(table, "a", "x").count() == 1


def test_upsert_is_idempotent_and_replaces(spark):
    old = facts(spark, ("s1", "2024-01-01", 3), ("s2", "2024-01-01", 4))
    batch = facts(spark, ("s1", "2024-01-01", 5), ("s3", "2024-01-02", 6))
    once = U.upsert_daily(old, batch)
    assert rows_of(once) == {("s1", day("2024-01-01"), 5), ("s2", day("2024-01-01"), 4), ("s3", day("2024-01-02"), 6)}
    assert rows_of(U.upsert_daily(once, batch)) == rows_of(once)


def test_prune_keeps_exactly_the_window(spark):
    both = stations(spark, "a").unionByName(stations(spark, "b", city="y"))
    data = facts(spark, ("a", "2024-12-31", 1), ("a", "2024-01-01", 2), ("a", "2023-12-31", 3), ("b", "2020-01-01", 4))
    assert {r.entries for r in U.prune(both, data).collect()} == {1, 2, 4}
    assert {tuple(r) for r in U.pruned_counts(both, data).collect()} == {("x", 1, 2), ("y", 0, 1)}
    assert U.prune(both, data.limit(0)).count() == 0


def test_insert_absent_adds_once(spark):
    old = spark.createDataFrame([("s", "A", "a")], "station_id string, alias_name string, normalized string")
    new = spark.createDataFrame([("s", "A", "other"), ("s", "B", "b"), ("s", "B", "b")], old.schema)
    assert rows_of(U.insert_absent(old, new, ["station_id", "alias_name"])) == {("s", "A", "a"), ("s", "B", "b")}


def test_line_rules(spark):
    names = ["Austin (Blue)", "Harlem-Green", "Belmont (Red/Brown/Purple)", "35th-Bronzeville-IIT", "Cottage Grove", "Polk", "Nowhere"]
    table = spark.createDataFrame([(n, ["?"]) for n in names], "name string, lines array<string>")
    both = rules.LINE_RULES + rules.FULL_LINE_RULES
    got = {r.name: r.lines for r in U.assign_lines(table, both).collect()}
    assert got == {
        "Austin (Blue)": ["Blue"], "Harlem-Green": ["Green"], "Belmont (Red/Brown/Purple)": ["Red", "Brown", "Purple"],
        "35th-Bronzeville-IIT": ["Green"], "Cottage Grove": ["Green"], "Polk": ["Pink"], "Nowhere": ["?"],
    }


def test_repairs(spark):
    metrics = spark.createDataFrame([("", "2024-05-01", 0.0, 2.0, 0), ("2024-04-01", "2024-05-01", 1.0, 2.0, 0)],
                                    "service_date_max string, last_updated string, rolling_30d_avg double, rolling_90d_avg double, last_day_entries bigint")
    got = rows_of(U.repair_zeros(U.repair_dates(metrics)).drop("last_updated"))
    assert got == {(day("2024-05-01"), None, 2.0, None), (day("2024-04-01"), 1.0, 2.0, 0)}


def test_coverage_warning(spark):
    data = facts(spark, ("a", "2024-01-01", 1), ("b", "2022-01-01", 1))
    got = M.window_coverage(stations(spark, "a", "b", "c"), data, day("2024-01-02"))
    assert tuple(got.first()) == (1, 3, 1)
