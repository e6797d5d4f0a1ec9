"""Relations behind the ranked list and the station page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics import rules, schemas
from hubmetrics.functions.parse import round_half_up
from hubmetrics.operators.score import comparison_text, percent_less, percentiles, serving_status
from hubmetrics.operators.metrics import system_average
from hubmetrics.storage import materialize

_METRIC_COLUMNS = ["score", "rolling_30d_avg", "last_day_entries", "service_date_max"]


def _joined(stations: DataFrame, metrics: DataFrame) -> DataFrame:
    return stations.join(metrics.select("station_id", *_METRIC_COLUMNS), "station_id", "left")


def _list_order(sort: str, collation: str | None = None) -> list[Column]:
    score, average = F.coalesce("score", F.lit(0)), F.coalesce("rolling_30d_avg", F.lit(0.0))
    name = F.col("name") if collation is None else F.collate("name", collation)
    orders = {
        "score_desc": score.desc(), "score_asc": score.asc(), "name": name.asc(), "ridership": average.desc(),
    }
    return [orders.get(sort, orders["score_desc"]), F.col("station_id").asc()]


def station_list(
    stations: DataFrame, metrics: DataFrame, sort: str = "score_desc", limit: int | None = 25, collation: str | None = None
) -> DataFrame:
    """The ranked list: no score counts as 0, zero averages show as NULL, ties go by station id.

    ``list_rank`` numbers a limited list from 1. Names sort by their bytes, or by a collation such as UNICODE.
    """
    order = _list_order(sort, collation)
    listed = _joined(stations, metrics)
    if limit is None:
        listed = listed.orderBy(*order)
    else:
        # After the limit the window holds no more than ``limit`` rows.
        top = listed.orderBy(*order).limit(limit)
        listed = top.withColumn("list_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return listed.withColumns({
        "score": F.coalesce("score", F.lit(0)),
        "rolling_30d_avg": F.nullif(F.col("rolling_30d_avg"), F.lit(0.0)),
        "last_day_entries": F.nullif(F.col("last_day_entries"), F.lit(0)),
    })


def raw_station_list(stations: DataFrame, metrics: DataFrame, sort: str = "score_desc") -> DataFrame:
    """The whole list with serving status; NULLs sort as the smallest values and show as 0."""
    columns = {
        "score_desc": F.col("score").desc_nulls_last(), "score_asc": F.col("score").asc_nulls_first(),
        "name": F.col("name").asc_nulls_first(), "ridership": F.col("rolling_30d_avg").desc_nulls_last(),
    }
    return (
        _joined(stations, metrics)
        .orderBy(columns.get(sort, columns["score_desc"]), F.col("station_id").asc())
        .withColumns({
            "data_status": serving_status(F.col("service_date_max"), F.col("rolling_30d_avg")),
            "score": F.coalesce("score", F.lit(0)),
            "rolling_30d_avg": F.coalesce("rolling_30d_avg", F.lit(0.0)),
            "last_day_entries": F.coalesce("last_day_entries", F.lit(0)),
        })
    )


def lowest(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The k least used stations with data."""
    return _ends(metrics, F.col("rolling_30d_avg").asc(), F.col("station_id").asc(), k, "lowest")


def busiest(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The k busiest stations with data."""
    return _ends(metrics, F.col("rolling_30d_avg").desc(), F.col("station_id").desc(), k, "busiest")


def _ends(metrics: DataFrame, first: Column, second: Column, k: int, label: str) -> DataFrame:
    top = metrics.where(F.col("data_status") != "missing").orderBy(first, second).limit(k)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(first, second))
    return top.withColumns({"list_name": F.lit(label), "list_rank": place})


def first_missing(metrics: DataFrame, k: int = 10) -> DataFrame:
    return metrics.where(F.col("data_status") == "missing").orderBy("name", "station_id").limit(k).select("station_id", "name")


def station_details(stations: DataFrame, metrics: DataFrame) -> DataFrame:
    """For every station at once: percentile, rounded system average, comparison in percent and in words."""
    whole = _whole(stations, metrics)
    return _compared(percentiles(whole), system_average(whole))


def station_comparison(stations: DataFrame, metrics: DataFrame) -> DataFrame:
    """``station_details`` without the percentile, which is the only part that needs the stations in order."""
    whole = _whole(stations, metrics)
    return _compared(whole, system_average(whole))


def _whole(stations: DataFrame, metrics: DataFrame) -> DataFrame:
    return materialize(stations.join(metrics.drop("city_code", "name"), "station_id", "left"), "details")


def _compared(whole: DataFrame, averages: DataFrame) -> DataFrame:
    less = percent_less(F.col("system_average"), F.col("rolling_30d_avg"))
    return (
        whole.join(averages, "city_code", "left")
        .withColumn("percent_less", less)
        .withColumns({
            "explanation": comparison_text(F.col("percent_less")),
            "system_average": round_half_up(F.coalesce("system_average", F.lit(0.0))).cast("bigint"),
            "score": F.coalesce("score", F.lit(0)),
            "rolling_30d_avg": F.nullif(F.col("rolling_30d_avg"), F.lit(0.0)),
            "last_day_entries": F.nullif(F.col("last_day_entries"), F.lit(0)),
        })
    )


def find_station(stations: DataFrame, station_id, city_code: Column | str) -> DataFrame:
    """The station with that id, no row if it lies in another city."""
    return stations.where((F.col("station_id") == F.lit(station_id)) & (F.col("city_code") == F.lit(city_code)))


def last_days(facts: DataFrame, as_of: DataFrame, days: int = rules.LONG_WINDOW_DAYS) -> DataFrame:
    """Facts of the last days before the date in the one-row ``as_of``, that bound included."""
    return facts.where(F.col("service_date") >= F.date_sub(as_of.scalar(), days))


def first_per_date(series: DataFrame, order: Column) -> DataFrame:
    """One row per station and date, the first in the given order."""
    return series.groupBy("station_id", "service_date").agg(F.min_by("entries", order).alias("entries"))


def stored_station(spark: SparkSession, path: str, city_code: str, station_id) -> DataFrame:
    """The stored metrics of one station: one city's folder, cut down by the id in the scan. Nothing is computed or shuffled.

    ``path`` is a folder that ``write_metrics`` wrote. An unknown city or id gives no row.
    """
    stored = spark.read.schema(schemas.metrics(T.StringType() if isinstance(station_id, str) else T.LongType())).parquet(path)
    return stored.where((F.col("city_code") == city_code) & (F.col("station_id") == station_id))
