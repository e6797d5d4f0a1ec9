"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubmetrics.functions.names import normalize_name
from hubmetrics.functions.parse import malformed_json
from hubmetrics.operators.match import unmatched_reasons


def unmatched_names(unmatched: DataFrame, name: str = "stationname") -> DataFrame:
    return unmatched.groupBy(name).agg(F.count(F.lit(1)).alias("occurrences"))


def unmatched_report(unmatched: DataFrame, stations: DataFrame, hints) -> DataFrame:
    """Per (ridership_id, stationname): normal form, reason, occurrences, date and rides of the first record."""
    pairs = unmatched.groupBy("ridership_id", "stationname").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("date", "rides")).alias("_first")
    )
    return (
        unmatched_reasons(pairs, stations, hints)
        .withColumns({
            "normalized": normalize_name(F.col("stationname")),
            "sample_date": F.col("_first.date"),
            "sample_rides": F.col("_first.rides"),
        })
        .drop("_first")
    )


def match_summary(matched: DataFrame, rows: str | None = None) -> DataFrame:
    """Totals of a load. ``match_rate`` has only matched ids below the line; ``true_match_rate`` has all ids there.

    ``matched`` holds matched records, or matched ``pair_counts`` with their number in the column ``rows``, so that the
    records themselves are never joined or shuffled. All is reduced to distinct (ridership id, station) before ids are
    counted, which keeps the counting small.
    """
    pairs = matched.groupBy("ridership_id", "station_id").agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))
    hit = F.col("station_id").isNotNull()
    totals = pairs.agg(
        F.sum("n").alias("fetched"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("skipped"),
        F.count_distinct("ridership_id").alias("ids"),
        F.count_distinct(F.when(hit, F.col("ridership_id"))).alias("matched_ids"),
        F.count_distinct("station_id").alias("matched_stations"),
    )
    return totals.withColumns({
        "match_rate": F.try_divide(F.col("matched_stations"), F.col("matched_ids")) * 100,
        "true_match_rate": F.try_divide(F.col("matched_ids"), F.col("ids")) * 100,
    })


def days_with_data(stations: DataFrame, facts: DataFrame) -> DataFrame:
    """Per station name: days with data, first and last date; stations without data are kept.

    Several stations may share a name; a day then counts once. The facts are reduced to distinct (station, day) before they
    meet the stations, so a station with very many facts is one row per day and task; the names without data are added last.
    """
    days = facts.select("station_id", "service_date").distinct()
    named = days.join(stations.select("station_id", "name"), "station_id").select("name", "service_date").distinct()
    counted = named.groupBy("name").agg(
        F.count("service_date").alias("days_with_data"),
        F.min("service_date").alias("earliest_date"),
        F.max("service_date").alias("latest_date"),
    )
    names = stations.select(F.col("name").alias("_name")).distinct()
    return names.join(counted, F.col("_name").eqNullSafe(F.col("name")), "left").select(
        F.col("_name").alias("name"), F.coalesce("days_with_data", F.lit(0)).cast("bigint").alias("days_with_data"),
        "earliest_date", "latest_date",
    )


def station_totals(stations: DataFrame, facts: DataFrame) -> DataFrame:
    """Per station: records, latest date, sum of entries; largest sum first, stations without data last."""
    per_station = facts.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("records"), F.max("service_date").alias("latest_date"), F.sum("entries").alias("total_entries")
    )
    return (
        stations.select("station_id", "name").join(per_station, "station_id", "left")
        .withColumn("records", F.coalesce("records", F.lit(0)).cast("bigint"))
        .orderBy(F.col("total_entries").desc_nulls_last(), "station_id")
    )


def alias_coverage(aliases: DataFrame) -> DataFrame:
    return aliases.agg(
        F.count(F.lit(1)).alias("total_aliases"), F.count_distinct("station_id").alias("stations_with_aliases")
    )


def lines_group_counts(stations: DataFrame) -> DataFrame:
    """Stations per line list, with the first name of each as an example."""
    return stations.groupBy("lines").agg(F.count(F.lit(1)).alias("n_stations"), F.min("name").alias("example_name")).orderBy(
        F.col("n_stations").desc()
    )


def summary_union(stations: DataFrame, facts: DataFrame, metrics: DataFrame, start) -> DataFrame:
    """Labelled counts as rows: all stations, those with data since ``start``, those without, those with metrics."""
    recent = facts.where(F.col("service_date") >= start).groupBy("station_id").agg(F.lit(1).alias("hit"))
    measured = metrics.groupBy("station_id").agg(F.lit(1).alias("measured"))
    counts = (
        stations.select("station_id").join(recent, "station_id", "left").join(measured, "station_id", "left")
        .agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.count("measured").alias("measured"))
    )
    stacked = F.stack(
        F.lit(4),
        F.lit("Total stations"), F.col("n"),
        F.lit("Stations with ridership data"), F.col("hits"),
        F.lit("Stations with 0 rows"), F.col("n") - F.col("hits"),
        F.lit("Stations with metrics"), F.col("measured"),
    )
    return counts.select(stacked.alias("metric", "value"))


def malformed_lines(stations: DataFrame, limit: int | None = 20) -> DataFrame:
    """Stations whose lines text is no plain JSON array, by id."""
    bad = stations.where(malformed_json(F.col("lines"))).select(
        "station_id", "name", "lines", F.length("lines").alias("lines_length")
    )
    return bad if limit is None else bad.orderBy("station_id").limit(limit)


def any_like(column: str, patterns: Sequence[str]):
    """Whether a column fits one of some LIKE patterns, whatever the case."""
    return F.exists(F.array(*[F.col(column).ilike(p) for p in patterns]), lambda hit: hit)


def external_id_status(stations: DataFrame) -> DataFrame:
    status = F.when(F.col("external_id").isNull(), "NO EXTERNAL ID").otherwise("HAS EXTERNAL ID")
    return stations.withColumn("status", status)


def defect_counts(metrics: DataFrame) -> DataFrame:
    """Rows with an empty date, with a zero average, and with a NULL average."""
    empty = F.col("service_date_max").isNull() | (F.col("service_date_max").cast("string") == "")
    zero = (F.col("rolling_30d_avg") == 0) | (F.col("rolling_90d_avg") == 0)
    null = F.col("rolling_30d_avg").isNull() | F.col("rolling_90d_avg").isNull()
    return metrics.agg(
        F.count_if(empty).alias("empty_dates"), F.count_if(zero).alias("zero_averages"), F.count_if(null).alias("null_averages")
    )
