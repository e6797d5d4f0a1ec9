"""The 0-100 low-use score, percentiles, comparisons, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics.functions.parse import round_half_up
from hubmetrics.plans.ordered import with_position

NO_SCORE = -1


def _percent_left(position: Column, size: Column) -> Column:
    # The order of operations is part of the definition: the result is truncated.
    return F.greatest(F.lit(0), F.least(F.lit(100), (F.lit(100) - (position / size) * F.lit(100)).cast("int")))


def low_use_score(metrics: DataFrame, within: Sequence[str] = ("city_code",), equal_ties: bool = False) -> DataFrame:
    """Add ``score``: the less use, the higher; -1 for stations without data.

    Ties go by station id, or get the same score with ``equal_ties``. Stations without data form a group of their own,
    so one pass ranks both.
    """
    flagged = metrics.withColumn("_missing", F.col("data_status") == "missing")
    ranked = with_position(
        flagged, [*within, "_missing"], [F.col("rolling_30d_avg").asc(), F.col("station_id").asc()],
        ties=["rolling_30d_avg"] if equal_ties else (),
    )
    place = F.col("last_position" if equal_ties else "position")
    score = F.when(F.col("_missing"), F.lit(NO_SCORE)).otherwise(_percent_left(place, F.col("group_size")))
    return ranked.withColumn("score", score.cast("int")).select(*metrics.columns, "score")


def percentiles(metrics: DataFrame) -> DataFrame:
    """Add ``percentile``: stations of the city with a lower 30-day average, in percent of all; 100 where it is NULL."""
    ranked = with_position(
        metrics, ["city_code"], [F.col("rolling_30d_avg").asc_nulls_last(), F.col("station_id").asc()],
        ties=["rolling_30d_avg"],
    )
    lower = F.when(F.col("rolling_30d_avg").isNull(), F.col("group_size")).otherwise(F.col("first_position") - 1)
    percent = round_half_up(lower / F.col("group_size") * F.lit(100))
    return ranked.withColumn("percentile", percent.cast("bigint")).select(*metrics.columns, "percentile")


def bottom_text(percentile: Column) -> Column:
    return F.format_string("Bottom %d%%", F.lit(100) - percentile)


def percent_less(system_average: Column, average: Column) -> Column:
    """How much less use than the system average, in percent; negative for busy stations, NULL without data."""
    used = F.nullif(average, F.lit(0.0))
    return round_half_up(F.try_divide(system_average - used, system_average) * F.lit(100)).cast("bigint")


def comparison_text(percent: Column) -> Column:
    return F.when(percent.isNull(), "No ridership data available").otherwise(
        F.format_string("This station has %d%% less ridership than the system average", percent)
    )


def score_band(score: Column, strict: bool = False, bounds: Sequence[int] = (80, 60, 40, 20)) -> Column:
    """Band 1 (highest) to band ``len(bounds) + 1``; bounds count as reached unless ``strict``."""
    band = F.lit(len(bounds) + 1)
    for i, bound in reversed(list(enumerate(bounds, start=1))):
        band = F.when(score > bound if strict else score >= bound, F.lit(i)).otherwise(band)
    return band


def serving_status(service_date_max: Column, average: Column) -> Column:
    return F.when(service_date_max.isNull(), "missing").when(average == 0, "zero").otherwise("available")


def score_summary(scored: DataFrame) -> DataFrame:
    """Stations in all, with data and without, per city."""
    missing = F.count_if(F.col("data_status") == "missing")
    return scored.groupBy("city_code").agg(
        F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - missing).alias("with_data"), missing.alias("missing")
    )
