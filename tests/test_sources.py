"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.sources import features as E
from hubmetrics.sources import gtfs, ridership
from hubmetrics.sources.tables import read_table


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_stops_need_their_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="stop_lat"):
        gtfs.read_stops(spark, write(tmp_path / "stops.txt", "stop_id,stop_name,stop_lon\n1,a,2\n"))


def test_stations_from_stops(spark, tmp_path):
    path = write(tmp_path / "stops.txt", "﻿stop_id,stop_name,stop_lat,stop_lon,stop_desc,parent_station\n"
                 "30001,Platform A,41.1,-87.1,Red Line,40001\n30002,Platform B,41.2,-87.2,\"Blue, Brn\",40001\n"
                 "40001,Parent,41.5,-87.5,,\n30009,Orphan,41.9,-87.9,Pink,49999\n1234,Bus,41,-87,,\n50000,Bus 2,41,-87,Red,\n"
                 "30001,Platform A,41.1,-87.1,Red Line,40001\n")
    got = {r.external_id: r for r in gtfs.station_rows(gtfs.read_stops(spark, path), "x").collect()}
    assert set(got) == {"40001", "49999"}
    assert (got["40001"].name, got["40001"].latitude, got["40001"].lines) == ("Parent", 41.5, ["Blue", "Brown", "Red"])
    assert (got["49999"].name, got["49999"].longitude, got["49999"].lines) == ("Orphan", -87.9, ["Pink", "Purple"])


def test_repeated_stop_ids(spark, tmp_path):
    path = write(tmp_path / "stops.txt", "stop_id,stop_name,stop_lat,stop_lon,stop_desc,parent_station\n"
                 "40001,First,41.5,-87.5,Red,\n40001,Also,41.1,-87.1,Blue,\n40001,First,41.5,-87.5,Red,\n")
    stops = gtfs.read_stops(spark, path)
    assert sorted(r.stop_name for r in stops.collect()) == ["Also", "First"]
    got = gtfs.station_rows(stops, "x").collect()
    assert {r.name for r in got} == {"Also", "First"} and {(r.latitude, *r.lines) for r in got} == {(41.5, "Blue", "Red")}


def test_track_files(spark, tmp_path):
    routes = gtfs.read_routes(spark, write(tmp_path / "routes.txt", "﻿route_id,x\nRed,1\n22,1\nPexp,1\n"))
    assert [r.route_id for r in routes.collect()] == ["Red"]
    trips = gtfs.read_trips(spark, write(tmp_path / "trips.txt", "route_id,shape_id\nRed,s\nRed,s\nRed,\n"))
    assert [tuple(r) for r in trips.collect()] == [("Red", "s")]
    shapes = gtfs.read_shapes(spark, write(tmp_path / "shapes.txt", "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns,41.5,-87.5,1\n"))
    assert tuple(shapes.first()) == ("s", 41.5, -87.5, 1)


@pytest.mark.parametrize("header", ["stationname,date,rides", "station_name,service_date,total_rides", "station,date,entries"])
def test_ridership_csv(spark, tmp_path, header):
    path = write(tmp_path / "r.csv", header + "\nA,01/02/2024, 5 \nB,2024-01-02,x\nC,1/2/2024,5\n")
    typed = ridership.parse_csv_rows(ridership.read_ridership_csv(spark, path))
    assert {r.stationname: (str(r.service_date), r.entries, r.is_valid) for r in typed.collect()} == {
        "A": ("2024-01-02", 5, True), "B": ("2024-01-02", None, False), "C": ("None", 5, False),
    }


def test_ridership_csv_without_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="where, when"):
        ridership.read_ridership_csv(spark, write(tmp_path / "r.csv", "where,when\nA,B\n"))


def test_ridership_json_array(spark, tmp_path):
    rows = [{"station_id": "1", "stationname": "A", "date": "2024-01-05T00:00:00.000", "rides": "x"},
            {"station_id": "2", "stationname": "B", "date": "bad", "rides": "7"}]
    path = write(tmp_path / "r.json", json.dumps(rows))
    typed = ridership.parse_json_rows(ridership.read_ridership_json(spark, path))
    assert {r.ridership_id: (str(r.service_date), r.entries, r.is_valid) for r in typed.collect()} == {
        "1": ("2024-01-05", 0, True), "2": ("None", 7, False),
    }


def test_features_round_trip(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"segment_id": "s", "corridor": "Loop", "is_loop": True, "lines": ["Red"]},
               "geometry": {"type": "LineString", "coordinates": [[-87.1, 41.1], [-87.2, 41.2]]}}
    whole = write(tmp_path / "all.geojson", json.dumps({"type": "FeatureCollection", "features": [feature]}, indent=1))
    segments = E.read_segment_features(spark, whole, per_line=False)
    E.write_features(E.segment_features(segments), str(tmp_path / "out"))
    again = E.read_segment_features(spark, str(tmp_path / "out"))
    assert again.collect() == segments.collect()
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(text) == feature


def test_unmatched_report_file(spark, tmp_path):
    report = spark.createDataFrame([("1", 'A "B", C', "a b c", "why", 2)], "ridership_id string, stationname string, normalized string, reason string, occurrences bigint")
    E.write_report(E.unmatched_csv(report), str(tmp_path / "out"))
    assert tuple(spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').first()) == ("1", 'A "B", C', "a b c", "why", "2")


def test_city_predicate_reaches_the_scan(spark, tmp_path):
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "station_id string, city_code string")
    table.write.parquet(f"{tmp_path}/stations")
    got = read_table(spark, str(tmp_path), "stations", "x")
    assert got.count() == 1 and "EqualTo(city_code,x)" in got._jdf.queryExecution().executedPlan().toString()


def test_rule_tables_are_whole():
    assert (len(rules.ROUTE_LINES), len(rules.LINE_HINTS), len(rules.SPECIAL_NAMES), len(rules.KNOWN_ALIASES)) == (9, 38, 28, 60)
    assert (len(rules.ALIAS_RULES), len(rules.BRANCH_ALIAS_RULES), len(rules.LINE_RULES), len(rules.FULL_LINE_RULES)) == (60, 32, 23, 15)


def test_city_code_column(spark):
    stops = spark.createDataFrame([("40001", "A", "x", "1")], "stop_id string, stop_name string, stop_lat string, stop_lon string")
    row = gtfs.station_rows(stops, "x").select("city_code", "latitude", F.size("lines")).first()
    assert tuple(row) == ("x", None, 0)
