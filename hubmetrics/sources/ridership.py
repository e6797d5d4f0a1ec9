"""Readers for daily ridership feeds, and the typed rows made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics import schemas
from hubmetrics.functions.parse import parse_count, parse_count_or_zero, parse_iso_day, parse_service_date
from hubmetrics.sources.gtfs import read_text_table

# Column names under which the feed may carry a field, the preferred one first.
STATION_COLUMNS = ["stationname", "station_name", "station"]
DATE_COLUMNS = ["service_date", "date"]
RIDES_COLUMNS = ["rides", "total_rides", "entries"]


def resolve_columns(table: DataFrame) -> DataFrame:
    """Select stationname, service_date and rides, whatever the feed calls them."""
    def first_of(names: Sequence[str]) -> Column:
        for name in names:
            if name in table.columns:
                return F.col(name)
        raise ValueError(f"could not find required columns; found: {', '.join(table.columns)}")

    return table.select(
        first_of(STATION_COLUMNS).alias("stationname"), first_of(DATE_COLUMNS).alias("service_date"),
        first_of(RIDES_COLUMNS).alias("rides"),
    )


def read_ridership_csv(spark: SparkSession, path: str) -> DataFrame:
    return resolve_columns(read_text_table(spark, path, []))


def parse_csv_rows(rows: DataFrame) -> DataFrame:
    """Typed rows; ``is_valid`` is false where the date or the count could not be read."""
    typed = rows.select(
        "stationname", parse_service_date(F.col("service_date")).alias("service_date"),
        parse_count(F.col("rides")).alias("entries"), F.col("service_date").alias("raw_date"), F.col("rides").alias("raw_rides"),
    )
    return typed.withColumn("is_valid", F.col("service_date").isNotNull() & F.col("entries").isNotNull())


def read_ridership_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of the JSON feed, one per line or as an array per file, with the declared four text fields."""
    return spark.read.schema(schemas.RIDERSHIP_RECORD).json(path)


def parse_json_rows(records: DataFrame) -> DataFrame:
    """Typed records: an unreadable count is 0, an unreadable date leaves the row invalid."""
    typed = records.select(
        F.col("station_id").alias("ridership_id"), "stationname", parse_iso_day(F.col("date")).alias("service_date"),
        parse_count_or_zero(F.col("rides")).alias("entries"), "date", "rides",
    )
    return typed.withColumn("is_valid", F.col("service_date").isNotNull())
