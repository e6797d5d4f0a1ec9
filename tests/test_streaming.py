"""Landed files loaded by a stream: each once, idempotent, late rows kept apart."""

import datetime
import json
import random

from pyspark.sql import functions as F

from hubmetrics.operators.match import resolve_pairs
from hubmetrics.storage import lookup_table
from hubmetrics.streaming import incremental as I

STATION = "station_id string, city_code string, ridership_id string, name string, lines array<string>"


def land(folder, name, *rows):
    keys = ["station_id", "stationname", "date", "rides"]
    (folder / name).write_text("\n".join(json.dumps(dict(zip(keys, r))) for r in rows))


def test_three_runs_over_a_growing_folder(spark, tmp_path):
    landing, tables = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()
    stations = spark.createDataFrame([("A", "x", None, "Addison (Blue)", ["Blue"]), ("B", "x", "9", "Belmont", []), ("C", "x", None, "Clark", [])], STATION)
    batches = []

    def load(batch, batch_id):
        batches.append(batch_id)
        I.load_batch(batch, batch_id, stations, tables)
        I.load_batch(batch, batch_id, stations, tables)

    def run():
        I.run_available(I.stream_records(spark, str(landing)), load, str(tmp_path / "progress"))
        facts = spark.read.parquet(f"{tables}/facts")
        return {(r.station_id, str(r.service_date)): r.entries for r in facts.collect()}

    land(landing, "1.json", ("1", "Addison-O'Hare", "2024-03-01T00:00:00.000", "10"), ("9", "?", "2024-03-02T00:00:00.000", "20"),
         ("7", "Nowhere", "2024-03-02T00:00:00.000", "1"), ("1", "Addison-O'Hare", "bad date", "1"))
    assert run() == {("A", "2024-03-01"): 10, ("B", "2024-03-02"): 20}
    land(landing, "2.json", ("1", "Addison-O'Hare", "2024-03-01T00:00:00.000", "11"), ("9", "?", "2024-04-02T00:00:00.000", "x"),
         ("9", "?", "2023-03-01T00:00:00.000", "5"), ("9", "?", "2024-02-01T00:00:00.000", "6"))
    expected = {("A", "2024-03-01"): 11, ("B", "2024-03-02"): 20, ("B", "2024-04-02"): 0, ("B", "2024-02-01"): 6}
    assert run() == expected
    assert run() == expected and len(batches) == 2
    late = spark.read.parquet(f"{tables}/late").collect()
    assert [(r.station_id, str(r.service_date)) for r in late] == [("B", "2023-03-01")]
    unmatched = spark.read.parquet(f"{tables}/unmatched").collect()
    assert [r.stationname for r in unmatched] == ["Nowhere"]
    metrics = {r.station_id: (r.score, r.data_status) for r in spark.read.parquet(f"{tables}/metrics").collect()}
    # Both averages are 0: A has no row in the last 30 days and B a single one with an unreadable count. Ties go by id.
    assert metrics == {"A": (50, "normal"), "B": (0, "normal"), "C": (-1, "missing")}


def test_a_batch_is_read_from_its_source_once(spark, tmp_path):
    stations = spark.createDataFrame([("A", "x", None, "Addison (Blue)", ["Blue"]), ("B", "y", None, "Belmont", [])], STATION)
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return i

    rows = spark.createDataFrame([("1", "Addison-O'Hare", datetime.date(2024, 3, d), d) for d in range(1, 6)], "ridership_id string, stationname string, service_date date, entries bigint")
    records = rows.withColumn("ridership_id", F.udf(counted, "string").asNondeterministic()("ridership_id"))
    report = I.load_batch(records, 0, stations, str(tmp_path))
    assert seen.value == 5 and (report["fetched"], report["inserted"], report["cities"]) == (5, 5, 1)
    metrics = {r.station_id: (r.city_code, r.ridership_rows, r.score) for r in spark.read.parquet(f"{tmp_path}/metrics").collect()}
    assert metrics == {"A": ("x", 5, 0), "B": ("y", 0, -1)}


def test_a_date_is_parsed_once(spark, tmp_path, capsys):
    land(tmp_path, "1.json", ("1", "Addison", "2024-03-01T00:00:00.000", "10"))
    I.stream_records(spark, str(tmp_path)).explain()
    assert capsys.readouterr().out.count("as timestamp") == 1


def test_a_load_resolves_each_id_and_each_name_once(spark, tmp_path, monkeypatch):
    """The load's stations, learned ids and counts are those of the resolved pairs, with and without aliases."""
    stations = spark.createDataFrame(
        [("A", "x", None, "Addison (Blue)", ["Blue"]), ("B", "x", "5", "Belmont", []), ("C", "y", None, "Clark", []), ("D", "y", None, "Clark", [])], STATION)
    aliases = spark.createDataFrame([("D", "Odd", "odd"), ("B", "Clark", "clark")], "station_id string, alias_name string, normalized string")
    names = ["Addison-O'Hare", "Belmont", "Clark", "Odd", "Odder", "Lost", None]
    pick = random.Random(3)
    rows = [(pick.choice(["5", "6", "7", "8", "9", "", " ", None]), pick.choice(names), datetime.date(2024, 3, 1 + k % 20), k) for k in range(24)]
    rows += [("9", "Lost", datetime.date(2024, 3, 1), 100), ("6", "Odder", None, 101)]
    records = spark.createDataFrame(rows, "ridership_id string, stationname string, service_date date, entries bigint")
    dated = records.where("service_date IS NOT NULL")
    pairs = {(r.ridership_id, r.stationname): r.station_id for r in resolve_pairs(dated, stations).collect()}
    written = []

    def noted(df, label):
        copy = lookup_table(df, label)
        written.append((label, copy.count()))
        return copy

    monkeypatch.setattr(I, "lookup_table", noted)
    for listed in (None, aliases):
        tables = f"{tmp_path}/{'named' if listed is None else 'listed'}"
        own = {} if listed is None else {"Odd": "D", "Odder": None, "Clark": "B", "Belmont": "B"}
        told = {(i, n): own.get(n) or found for (i, n), found in pairs.items()}
        report = I.load_batch(records, 0, stations, tables, aliases=listed)
        ids = {i for i, _ in told if i is not None}
        hits = {i for (i, _), found in told.items() if found and i is not None}
        assert (report["fetched"], report["ids"], report["matched_ids"], report["matched_stations"]) == (
            25, len(ids), len(hits), len({found for found in told.values() if found}))
        facts = {}
        for i, n, day, entries in rows:
            if day and told[i, n]:
                facts[told[i, n], day] = max(entries, facts.get((told[i, n], day), 0))
        assert {(r.station_id, r.service_date): r.entries for r in spark.read.parquet(f"{tables}/facts").collect()} == facts
        assert sorted(map(repr, map(tuple, spark.read.parquet(f"{tables}/unmatched").drop("batch").collect()))) == sorted(
            repr(r) for r in rows if r[2] and not told[r[:2]])
        taught = {i: min(found for (j, _), found in told.items() if found and j == i) for i in hits if i.strip()}
        assert {r.ridership_id: r.station_id for r in spark.read.parquet(f"{tables}/learned").collect()} == taught
        assert ("resolved", len(ids)) in written and not {"pairs", "ids"} & {label for label, _ in written}


def test_retained_reads_only_months_in_the_window(spark, tmp_path):
    stations = spark.createDataFrame([("A", "x", None, "A", [])], STATION)
    days = spark.createDataFrame([("A", datetime.date(2024, 12, 31), 1), ("A", datetime.date(2024, 1, 1), 2), ("A", datetime.date(2023, 12, 31), 3)],
                                 "station_id string, service_date date, entries bigint")
    facts = I.DailyFacts(spark, f"{tmp_path}/facts")
    facts.merge(days, F.col("entries"))
    cutoffs = I.batch_cutoffs(stations, days, None, 365)
    kept = I.retained(facts.read(days), cutoffs)
    assert {r.entries for r in kept.collect()} == {1, 2}
    assert "PartitionFilters: [isnotnull(month" in kept._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters: [coalesce((month" in kept._jdf.queryExecution().executedPlan().toString()


def test_loads_prune_the_disk_and_keep_learned_ids(spark, tmp_path):
    tables = str(tmp_path / "tables")
    stations = spark.createDataFrame([("A", "x", None, "Addison (Blue)", ["Blue"]), ("B", "y", "5", "Belmont", [])], STATION)
    record = "ridership_id string, stationname string, service_date date, entries bigint"
    rows = lambda *rs: spark.createDataFrame([(i, n, datetime.date.fromisoformat(d), e) for i, n, d, e in rs], record)
    facts = lambda: {(r.station_id, str(r.service_date), r.entries) for r in spark.read.parquet(f"{tables}/facts").collect()}

    first = rows(("9", "Addison-O'Hare", "2023-01-10", 1), ("9", "Addison-O'Hare", "2023-06-01", 2), ("9", "Addison-O'Hare", "2023-06-20", 3),
                 ("5", "Belmont", "2023-01-12", 4))
    I.load_batch(first, 0, stations, tables)
    assert len(facts()) == 4
    second = rows(("9", "Other spelling", "2024-06-10", 5), ("", "Other spelling", "2024-06-10", 6), (None, "Other spelling", "2024-06-10", 7))
    # A's city moves on, B's city stands still; January keeps only B's row and no folder keeps a row that is too old.
    expected = {("A", "2023-06-20", 3), ("A", "2024-06-10", 5), ("B", "2023-01-12", 4)}
    for _ in range(2):
        I.load_batch(second, 1, stations, tables)
        assert facts() == expected
    assert {r.entries for r in spark.read.parquet(f"{tables}/unmatched").collect()} == {6, 7}
    I.load_batch(rows(("5", "Belmont", "2025-02-01", 8)), 2, stations, tables)
    assert facts() == expected - {("B", "2023-01-12", 4)} | {("B", "2025-02-01", 8)}
    assert spark.read.parquet(f"{tables}/facts").where("month = '2023-01'").count() == 0


def test_mark_and_backfill(spark):
    today, day = datetime.date(2024, 1, 10), datetime.date(2024, 1, 5)
    facts = spark.createDataFrame([(day,)], "service_date date")
    mark = lambda df, since=None: I.high_water_mark(df, today, since).first().mark
    assert (mark(facts), mark(facts.limit(0)), mark(facts, datetime.date(2023, 1, 1))) == (day, datetime.date(2024, 1, 3), datetime.date(2023, 1, 1))
    records = spark.createDataFrame([(str(i), datetime.date(2024, 1, i)) for i in range(1, 9)], "ridership_id string, service_date date")
    assert [r.ridership_id for r in I.newer_than(records, I.high_water_mark(facts, today)).orderBy("ridership_id").collect()] == ["6", "7", "8"]
    chosen = I.backfill(records, datetime.date(2024, 1, 2), datetime.date(2024, 1, 4), ["1", "2", "4"])
    assert sorted(r.ridership_id for r in chosen.collect()) == ["2", "4"]
