"""Station metrics and the aggregates around them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.plans.ordered import with_day_ranges
from hubmetrics.storage import materialize


def facts_by_city(stations: DataFrame, facts: DataFrame) -> DataFrame:
    """Row count, first and last date per city; facts are reduced to one row per station before the join."""
    per_station = facts.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("service_date").alias("first"), F.max("service_date").alias("last")
    )
    return (
        stations.select("station_id", "city_code").join(per_station, "station_id")
        .groupBy("city_code")
        .agg(F.sum("n").alias("ridership_rows"), F.min("first").alias("first_date"), F.max("last").alias("last_date"))
    )


def anchored_stations(stations: DataFrame, facts: DataFrame, scope: str = "city", life: DataFrame | None = None) -> DataFrame:
    """Stations with their whole-life aggregates and ``anchor``, the last date of their city (or of all cities).

    The aggregates are written once, one row per station: everything after this reads that small table and not the facts.
    A caller that keeps them hands them in as ``life``.
    """
    life = life if life is not None else facts.groupBy("station_id").agg(
        F.count("entries").alias("ridership_rows"),
        F.max("entries").alias("max_entries"),
        F.max_by("entries", "service_date").alias("last_day_entries"),
        F.max("service_date").alias("service_date_max"),
    )
    base = materialize(stations.select("station_id", "city_code", "name").join(life, "station_id", "left"), "life")
    if scope == "global":
        return base.withColumn("anchor", base.agg(F.max("service_date_max")).scalar())
    last = base.groupBy("city_code").agg(F.max("service_date_max").alias("anchor"))
    return base.join(last, "city_code", "left")


def station_metrics(
    stations: DataFrame, facts: DataFrame, scope: str = "city", as_of: datetime.date | None = None, life: DataFrame | None = None,
) -> DataFrame:
    """Per station: rows, averages over the last 30 and 90 days (bounds included), maximum, last day, data status.

    ``facts`` holds one row per station and day. The full history is read once, reduced before the shuffle. The averages
    come from a second read that a date filter cuts to the last 90 days. With ``life``, one row per station that has
    facts, the history is not read at all, and ``facts`` may begin 90 days before each city's last date.
    """
    if as_of is not None:
        facts = facts.where(F.col("service_date") <= F.lit(as_of))
    anchored = anchored_stations(stations, facts, scope, life)
    oldest = anchored.agg(F.min(F.date_sub("anchor", rules.LONG_WINDOW_DAYS))).scalar()
    recent = (
        facts.where(F.col("service_date") >= oldest)
        .join(anchored.select("station_id", "anchor"), "station_id")
        .where(F.col("service_date") >= F.date_sub("anchor", rules.LONG_WINDOW_DAYS))
    )
    in_short = F.col("service_date") >= F.date_sub("anchor", rules.SHORT_WINDOW_DAYS)
    averages = recent.groupBy("station_id").agg(
        F.avg(F.when(in_short, F.col("entries"))).alias("rolling_30d_avg"), F.avg("entries").alias("rolling_90d_avg")
    )
    has_rows = F.coalesce("ridership_rows", F.lit(0))
    return anchored.join(averages, "station_id", "left").select(
        "station_id", "city_code", "name",
        has_rows.cast("bigint").alias("ridership_rows"),
        F.coalesce("rolling_30d_avg", F.lit(0.0)).alias("rolling_30d_avg"),
        F.coalesce("rolling_90d_avg", F.lit(0.0)).alias("rolling_90d_avg"),
        F.coalesce("max_entries", F.lit(0)).cast("bigint").alias("max_entries"),
        F.coalesce("last_day_entries", F.lit(0)).cast("bigint").alias("last_day_entries"),
        "service_date_max",
        F.when(has_rows == 0, "missing").otherwise("normal").alias("data_status"),
    )


def system_average(metrics: DataFrame, exclude_missing: bool = False) -> DataFrame:
    """Mean 30-day average per city; missing stations count as zero unless they are excluded."""
    if exclude_missing:
        metrics = metrics.where(F.col("data_status") != "missing")
    return metrics.groupBy("city_code").agg(F.avg("rolling_30d_avg").alias("system_average"))


def data_as_of(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("city_code").agg(F.max("service_date_max").alias("data_as_of"))


def window_coverage(
    stations: DataFrame, facts: DataFrame, as_of: DataFrame | datetime.date, days: int = rules.RETENTION_DAYS,
    expected: int = rules.EXPECTED_STATIONS,
) -> DataFrame:
    """Stations with a fact in the last days, all stations, and whether fewer have data than expected.

    ``as_of`` is a date or a one-row DataFrame that holds it.
    """
    end = as_of.scalar() if isinstance(as_of, DataFrame) else F.lit(as_of)
    active = facts.where(F.col("service_date") >= F.date_sub(end, days)).groupBy("station_id").agg(F.lit(1).alias("hit"))
    covered = F.count("hit")
    return stations.select("station_id").join(active, "station_id", "left").agg(
        covered.alias("stations_with_data"),
        F.count(F.lit(1)).alias("total_stations"),
        (covered < expected).cast("int").alias("below_expected"),
    )


def stations_in_window(stations: DataFrame, facts: DataFrame, start) -> DataFrame:
    """Stations with a fact on or after ``start``."""
    recent = facts.where(F.col("service_date") >= start).select("station_id").distinct()
    return stations.join(recent, "station_id", "left_semi")


def stations_without_data(stations: DataFrame, facts: DataFrame, start) -> DataFrame:
    """Stations without a fact on or after ``start``."""
    recent = facts.where(F.col("service_date") >= start).select("station_id").distinct()
    return stations.join(recent, "station_id", "left_anti")


def rows_in_window(stations: DataFrame, facts: DataFrame, start) -> DataFrame:
    """Every station with its number of facts on or after ``start``, 0 included."""
    n = facts.where(F.col("service_date") >= start).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    return stations.join(n, "station_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).withColumnRenamed(
        "n", "ridership_rows"
    )


def moving_averages(facts: DataFrame, unique: bool = False) -> DataFrame:
    """``station_id, service_date, entries, avg_30d, avg_90d``: the mean of the days up to each day with data, that day included.

    Facts with one row per station and day are ``unique`` and are not added up once more.
    """
    ranged = with_day_ranges(
        facts, ["station_id"], "service_date", "entries",
        {"avg_30d": rules.SHORT_WINDOW_DAYS, "avg_90d": rules.LONG_WINDOW_DAYS}, unique)
    return ranged.select("station_id", "service_date", F.col("_sum").alias("entries"), "avg_30d", "avg_90d")
