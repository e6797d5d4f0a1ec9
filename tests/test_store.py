"""Loads by city and month: state against full computation, folders read and written, replay, compaction, marks."""

import contextlib
import datetime
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from hubmetrics.operators.metrics import station_metrics
from hubmetrics.operators.score import low_use_score
from hubmetrics.operators.serve import stored_station
from hubmetrics.sources import folders
from hubmetrics.sources.tables import read_table
from hubmetrics.storage import materialize
from hubmetrics.streaming import incremental as I
from hubmetrics.streaming import store as S
from hubmetrics.streaming.store import CityStore, month_names

FACT = "station_id string, service_date date, entries bigint"
STATION = "station_id string, city_code string, ridership_id string, name string, lines array<string>"
DAY = datetime.date(2024, 6, 30)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


@pytest.fixture
def stations(spark):
    rows = [(f"{c}{k}", c, None, f"{c}{k}", []) for c in ("x", "y y", "007") for k in range(3)]
    return spark.createDataFrame(rows, STATION)


def test_loads_equal_a_full_computation(spark, tmp_path, stations):
    random.seed(8)
    store = CityStore(spark, str(tmp_path), stations, days=100)
    kept, last = {}, {}

    def load(rows):
        result = store.load(spark.createDataFrame([(s, d, e) for (s, d), e in rows.items()], FACT))
        for (s, d), e in rows.items():
            last[s[:-1]] = max(d, last.get(s[:-1], d))
        kept.update(rows)
        for s, d in [k for k in kept if k[1] < last[k[0][:-1]] - datetime.timedelta(100)]:
            del kept[s, d]
        return result

    def metrics(df):
        return sorted(map(tuple, df.select("station_id", "ridership_rows", "rolling_30d_avg", "rolling_90d_avg", "max_entries",
                                           "last_day_entries", "service_date_max", "data_status", "score").collect()))

    days = lambda n: DAY + datetime.timedelta(n)
    first = {(f"{c}{k}", days(-random.randint(0, 140))): random.randint(1, 99) for c in ("x", "y y", "007") for k in range(2) for _ in range(40)}
    first[("x2", days(0))] = None  # a day without a count
    late = load(first)["late"]
    assert late.count() == len(first) - len(kept) > 0
    untouched = files(tmp_path / "metrics" / "city_code=007")
    # Corrections downwards, the largest value among them, and days that push others out of the window.
    top = max((k for k in kept if k[0][0] == "x" and kept[k]), key=kept.get)
    second = {top: 0, ("x0", days(45)): 5, ("y y1", days(1)): 7}
    before = {k for k in kept}
    result = load(second)
    assert result["removed"] == len(before - set(kept)) > 0
    facts = spark.createDataFrame([(s, d, e) for (s, d), e in kept.items()], FACT)
    assert metrics(spark.read.parquet(str(tmp_path / "metrics"))) == metrics(low_use_score(station_metrics(stations, facts)))
    stored = {(r.station_id, r.service_date): r.entries for r in store.facts().collect()}
    assert stored == kept
    assert files(tmp_path / "metrics" / "city_code=007") == untouched
    counted = {r.station_id: r.days_with_data for r in store.days_with_data().collect()}
    assert counted == {s: sum(k[0] == s for k in kept) for s in {k[0] for k in kept}}
    covered = {r.city_code: r.stations_with_data for r in store.coverage(days(45), 75).collect()}
    assert covered == {c: n for c in last if (n := len({s for s, d in kept if s[:-1] == c and d >= days(-30)}))}
    # A load of one row reads the facts of its city's last 90 days and of no other city.
    read = {r[0] for r in store.recent(["007"]).select("_metadata.file_path").distinct().collect()}
    months = month_names(last["007"] - datetime.timedelta(90), last["007"])
    assert read and all("city_code=007" in f and any(f"month={m}/" in f for m in months) for f in read)
    # Running the load again leaves the facts as they are; codes stay texts; one folder answers a lookup.
    load(second)
    assert {(r.station_id, r.service_date): r.entries for r in store.facts().collect()} == kept
    found = stored_station(spark, str(tmp_path / "metrics"), "007", "0071")
    assert [r.city_code for r in found.collect()] == ["007"]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain("formatted")
    plan = text.getvalue()
    assert "EqualTo(station_id,0071)" in plan and "= 007)" in plan and "Exchange" not in plan and "Aggregate" not in plan
    assert read_table(spark, str(tmp_path), "metrics", "007", found.schema).count() == 3


def test_pruning_reads_and_writes_only_the_month_of_the_cutoff(spark, tmp_path, stations):
    store = CityStore(spark, str(tmp_path), stations, days=60)
    day = lambda m, d: datetime.date(2024, m, d)
    store.load(spark.createDataFrame([("x0", day(1, 5), 1), ("x0", day(1, 25), 2), ("x0", day(2, 10), 3), ("y y0", day(1, 5), 4)], FACT))
    before = files(tmp_path / "facts")
    assert store.load(spark.createDataFrame([("x0", day(4, 5), 5)], FACT))["removed"] == 2
    after = files(tmp_path / "facts")
    gone, new = set(before) - set(after), set(after) - set(before)
    assert {os.path.basename(os.path.dirname(f)) for f in gone} == {"month=2024-01"} and {os.path.basename(os.path.dirname(f)) for f in new} == {"month=2024-04"}
    assert store.load(spark.createDataFrame([("x0", day(4, 12), 6)], FACT))["removed"] == 1  # the cutoff falls on 12 February
    assert sorted(r.entries for r in store.facts().collect()) == [4, 5, 6]
    assert {(r.city_code, r.month) for r in store.months().collect()} == {("x", "2024-04"), ("y y", "2024-01")}
    assert store.load(spark.createDataFrame([("unknown", day(4, 5), 5)], FACT))["cities"] == []


def test_a_load_writes_timely_rows_only_and_each_month_once(spark, tmp_path, stations, monkeypatch):
    store = CityStore(spark, str(tmp_path), stations, days=60)
    day = lambda m, d: datetime.date(2024, m, d)
    store.load(spark.createDataFrame([("x0", day(2, 10), 1), ("x0", day(2, 20), 2), ("x1", day(2, 11), 3), ("x1", day(2, 12), 4)], FACT))
    written = []

    def noted(df, label, codec=None):
        copy = materialize(df, label, codec)
        written.append((label, copy.count()))
        return copy

    monkeypatch.setattr(S, "materialize", noted)
    # The cutoff falls on 12 February; the batch touches that month too and brings many rows before it.
    rows = [("x0", day(4, 12), 5), ("x0", day(2, 20), 6)] + [("x2", day(1, 1 + k % 30), k) for k in range(200)]
    result = store.load(spark.createDataFrame(rows, FACT), written=True)
    assert (result["removed"], result["late"].count()) == (2, 200)
    assert sorted((r.station_id, r.service_date, r.entries) for r in store.facts().collect()) == [
        ("x0", day(2, 20), 6), ("x0", day(4, 12), 5), ("x1", day(2, 12), 4)]
    assert max(n for _, n in written) == 3 and [label for label, _ in written].count("months") == 1
    assert sum(r.rows for r in store.months().collect()) == 3


def test_rows_that_are_learned_later_become_facts(spark, tmp_path):
    tables = str(tmp_path)
    stations = spark.createDataFrame([("A", "x", None, "Addison (Blue)", ["Blue"]), ("B", "x", "5", "Belmont", [])], STATION)
    rows = lambda *rs: spark.createDataFrame(
        [(i, n, datetime.date.fromisoformat(d), e) for i, n, d, e in rs], "ridership_id string, stationname string, service_date date, entries bigint")
    facts = lambda: {(r.station_id, str(r.service_date), r.entries) for r in spark.read.parquet(f"{tables}/facts").collect()}
    first = I.load_batch(rows(("9", "Odd", "2024-01-01", 1), ("9", "Odd", "2024-01-02", 2), ("8", "Odder", "2024-01-01", 3), ("5", "?", "2024-01-01", 4)), 0, stations, tables)
    assert (first["fetched"], first["inserted"], first["skipped"], first["ids"], first["matched_ids"]) == (4, 1, 3, 3, 1)
    assert facts() == {("B", "2024-01-01", 4)}
    second = rows(("9", "Addison-O'Hare", "2024-01-02", 20), ("9", "Addison-O'Hare", "2024-01-03", 30))
    expected = {("B", "2024-01-01", 4), ("A", "2024-01-01", 1), ("A", "2024-01-02", 20), ("A", "2024-01-03", 30)}
    for _ in range(2):
        report = I.load_batch(second, 1, stations, tables)
        assert facts() == expected and (report["inserted"], report["true_match_rate"]) == (2, 100.0)
        assert [r.stationname for r in spark.read.parquet(f"{tables}/unmatched").collect()] == ["Odder"]
    assert sorted((r.batch, r.skipped) for r in I.read_reports(spark, tables).collect()) == [(0, 3), (1, 0)]
    aliases = spark.createDataFrame([("B", "Odder", "odder")], "station_id string, alias_name string, normalized string")
    I.load_batch(rows(("", "Odder", "2024-01-09", 8)), 2, stations, tables, aliases=aliases)
    assert facts() == expected | {("B", "2024-01-09", 8)}


def test_batch_folders_stay_few_and_whole(spark, tmp_path):
    path = str(tmp_path / "late")
    row = spark.createDataFrame([(1,)], "v bigint")
    for batch in range(12):
        folders.compact(spark, path, row.schema, batch, 3)
        row.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        assert len(folders.names(spark, path)) <= 5
    assert folders.batch_rows(spark, path, row.schema).count() == 12
    # A run that stopped after the merged rows were complete, and one that stopped before.
    row.write.parquet(f"{path}/_merged-11")
    row.write.parquet(f"{path}/_merged-5")
    folders.drop(spark, f"{path}/_merged-5/_SUCCESS")
    folders.compact(spark, path, row.schema, 12, 3)
    assert folders.names(spark, path) == ["batch=11"] and folders.batch_rows(spark, path, row.schema).count() == 1
    assert folders.batch_rows(spark, str(tmp_path / "none"), row.schema).count() == 0


def test_marks_of_cities_skip_folders(spark, tmp_path, stations):
    day = lambda m, d: datetime.date(2024, m, d)
    metrics = spark.createDataFrame([("x", day(3, 10)), ("x", day(3, 20)), ("y y", day(5, 1)), ("007", None)], "city_code string, service_date_max date")
    marks = I.city_marks(stations, metrics, day(5, 20))
    assert {(r.city_code, r.mark) for r in marks.collect()} == {("x", day(3, 20)), ("y y", day(5, 1)), ("007", day(5, 13))}
    assert {r.mark for r in I.city_marks(stations, metrics, day(5, 20), day(1, 1)).collect()} == {day(1, 1)}
    rows = [(c, day(m, d)) for c in ("x", "y y", "007", "other") for m in (1, 3, 5, 7) for d in (1, 20, 25)]
    landed = str(tmp_path / "landed")
    spark.createDataFrame(rows, "city_code string, service_date date").withColumn("month", F.date_format("service_date", "yyyy-MM")).write.partitionBy(
        "city_code", "month").parquet(landed)
    records = spark.read.schema("service_date date, city_code string, month string").parquet(landed)
    newer = I.newer_than_marks(records, marks, day(5, 20))
    own = {r.city_code: r.mark for r in marks.collect()}
    assert sorted(tuple(r) for r in newer.select("city_code", "service_date").collect()) == sorted(r for r in rows if r[0] in own and r[1] > own[r[0]])
    assert "dynamicpruning" in newer._jdf.queryExecution().executedPlan().toString()
    ahead = I.newer_than_marks(records, marks.withColumn("mark", F.lit(day(7, 20))), day(5, 20))
    assert {(r.city_code, r.service_date) for r in ahead.collect()} == {(c, day(7, 25)) for c in own}
