"""Declared schemas of the feeds and of the tables at rest."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
LINES = T.ArrayType(TEXT)
POINT = _struct(lon=DOUBLE, lat=DOUBLE)

CITY = _struct(code=TEXT, name=TEXT)
STATION = _struct(
    station_id=TEXT, city_code=TEXT, external_id=TEXT, ridership_id=TEXT, name=TEXT,
    latitude=DOUBLE, longitude=DOUBLE, lines=LINES,
)
ALIAS = _struct(station_id=TEXT, alias_name=TEXT, normalized=TEXT)
FACT = _struct(station_id=TEXT, service_date=T.DateType(), entries=LONG)
METRICS = _struct(
    station_id=TEXT, city_code=TEXT, name=TEXT, ridership_rows=LONG, rolling_30d_avg=DOUBLE, rolling_90d_avg=DOUBLE,
    max_entries=LONG, last_day_entries=LONG, service_date_max=T.DateType(), data_status=TEXT, score=T.IntegerType(),
)
RIDERSHIP_RECORD = _struct(station_id=TEXT, stationname=TEXT, date=TEXT, rides=TEXT)
RECORD = _struct(ridership_id=TEXT, stationname=TEXT, service_date=T.DateType(), entries=LONG)
REPORT = _struct(
    batch=LONG, fetched=LONG, inserted=LONG, skipped=LONG, ids=LONG, matched_ids=LONG, matched_stations=LONG, removed=LONG,
    cities=LONG, match_rate=DOUBLE, true_match_rate=DOUBLE,
)
MONTH_STATE = _struct(
    rows=LONG, n=LONG, total=LONG, max_entries=LONG, first=T.DateType(), last=T.DateType(), last_entries=LONG, days=LONG,
)
SEGMENT = _struct(segment_id=TEXT, corridor=TEXT, is_loop=T.BooleanType(), lines=LINES, p1=POINT, p2=POINT)
FEATURE = T.StructType([
    T.StructField("type", TEXT),
    T.StructField("properties", _struct(segment_id=TEXT, corridor=TEXT, is_loop=T.BooleanType(), lines=LINES)),
    T.StructField("geometry", T.StructType([
        T.StructField("type", TEXT),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(DOUBLE))),
    ])),
])


def metrics(id_type: T.DataType) -> T.StructType:
    """Stored metrics of stations with ids of this type."""
    return T.StructType([T.StructField("station_id", id_type), *METRICS.fields[1:]])
