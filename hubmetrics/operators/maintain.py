"""Upserts, pruning and repairs, as DataFrames in and DataFrames out.

Each returns the new content of a table. Old and new rows are reduced per key before the shuffle, so neither repeated
keys nor a hot key pile up anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions.names import surrogate_key
from hubmetrics.plans.ordered import latest_by_key
from hubmetrics.storage import materialize


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column | None = None) -> DataFrame:
    """New rows replace old ones with the same key; among new rows the last in ``order`` wins, a missing order is the first.

    Without an order, or among equals, the largest values win, so the result never depends on how rows are read.
    """
    rank = F.lit(0).cast("bigint") if order is None else order.cast("bigint")
    columns = [*keys, *values]
    both = old.select(*columns, F.lit(False).alias("_new"), F.lit(None).cast("bigint").alias("_rank")).unionByName(
        new.select(*columns, F.lit(True).alias("_new"), rank.alias("_rank")))
    return latest_by_key(both, keys, values, F.struct("_new", F.coalesce("_rank", F.lit(-(2**63))), *values))


def upsert_daily(facts: DataFrame, batch: DataFrame, order: Column | None = None) -> DataFrame:
    return upsert(facts, batch, ["station_id", "service_date"], ["entries"], order)


def upsert_stations(stations: DataFrame, batch: DataFrame) -> DataFrame:
    """Known (city, external id): new name, place and lines, same id. Unknown: a new row with a stable id.

    ``batch`` has one row per (city_code, external_id), as ``station_rows`` makes it.
    """
    keys, fresh = ["city_code", "external_id"], ["name", "latitude", "longitude", "lines"]
    new = batch.select(*keys, F.struct(*fresh).alias("_new"))
    joined = stations.join(new, keys, "full_outer")
    values = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
        for c in stations.columns if c != "station_id"
    ]
    station_id = F.coalesce(F.col("station_id").cast("string"), surrogate_key(*[F.col(k) for k in keys]))
    return joined.select(station_id.alias("station_id"), *values)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` plus the new rows whose key it lacks, one per key."""
    others = [c for c in old.columns if c not in keys]
    packed = F.struct(*others) if others else F.lit(1)
    unique = new.groupBy(*keys).agg(F.min(packed).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])
    return old.unionByName(unique.join(old, list(keys), "left_anti"))


def ensure_city(cities: DataFrame, code: str, name: str) -> DataFrame:
    """The cities with this one added if its code is new."""
    return insert_absent(cities, cities.sparkSession.createDataFrame([(code, name)], "code string, name string"), ["code"])


def store_learned_ids(stations: DataFrame, learned: DataFrame) -> DataFrame:
    """Stations with the ridership ids learned for them; learned ids replace stored ones."""
    new = learned.select("station_id", F.col("ridership_id").alias("_learned"))
    return (
        stations.join(new, "station_id", "left")
        .withColumn("ridership_id", F.coalesce("_learned", "ridership_id"))
        .select(*stations.columns)
    )


def replace_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """One metrics row per station: the new one where there is one; the row keeps its id."""
    values = [c for c in new.columns if c != "station_id"]
    joined = old.select("station_id", "id", F.struct(*values).alias("_old")).join(
        new.select("station_id", F.struct(*values).alias("_new")), "station_id", "full_outer"
    )
    best = F.coalesce("_new", "_old")
    row_id = F.coalesce("id", surrogate_key(F.col("station_id").cast("string")))
    return joined.select(row_id.alias("id"), "station_id", *[best[v].alias(v) for v in values])


def city_cutoffs(stations: DataFrame, facts: DataFrame, days: int) -> DataFrame:
    """Per station the oldest date its city keeps."""
    last = facts.groupBy("station_id").agg(F.max("service_date").alias("_last"))
    base = materialize(stations.select("station_id", "city_code").join(last, "station_id", "left"), "last")
    per_city = base.groupBy("city_code").agg(F.date_sub(F.max("_last"), days).alias("cutoff"))
    return base.join(per_city, "city_code").select("station_id", "city_code", "cutoff")


def prune(
    stations: DataFrame, facts: DataFrame, days: int = rules.RETENTION_DAYS, city_code: str | None = None
) -> DataFrame:
    """Facts no older than ``days`` before the last date of their city; other cities' facts stay as they are."""
    if city_code is not None:
        stations = stations.where(F.col("city_code") == city_code)
    cutoffs = city_cutoffs(stations, facts, days).select("station_id", "cutoff")
    joined = facts.join(cutoffs, "station_id", "left")
    return joined.where(F.col("cutoff").isNull() | (F.col("service_date") >= F.col("cutoff"))).drop("cutoff")


def pruned_counts(stations: DataFrame, facts: DataFrame, days: int = rules.RETENTION_DAYS) -> DataFrame:
    """Per city how many facts pruning removes and keeps."""
    cutoffs = city_cutoffs(stations, facts, days)
    per_day = facts.join(cutoffs, "station_id")
    old = F.col("service_date") < F.col("cutoff")
    return per_day.groupBy("city_code").agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def assign_lines(stations: DataFrame, line_rules: Sequence[tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Set ``lines`` by rules over the name; the last rule that fits wins, stations no rule fits keep their lines.

    A pattern with '%' is a LIKE pattern whatever the case, any other must equal the name. The rules are one CASE expression, so no join
    is needed.
    """
    def fits(patterns: Sequence[str]) -> Column:
        equal = [p for p in patterns if "%" not in p]
        tests = [F.col("name").ilike(p) for p in patterns if "%" in p]
        if equal:
            tests.append(F.col("name").isin(equal))
        any_fits = tests[0]
        for test in tests[1:]:
            any_fits = any_fits | test
        return any_fits

    result = None
    for patterns, lines in reversed(list(line_rules)):
        value = F.array(*[F.lit(line) for line in lines])
        result = F.when(fits(patterns), value) if result is None else result.when(fits(patterns), value)
    return stations if result is None else stations.withColumn("lines", result.otherwise(F.col("lines")))


def repair_dates(metrics: DataFrame) -> DataFrame:
    """A missing or empty ``service_date_max`` takes the day of ``last_updated``."""
    kept = F.nullif(F.col("service_date_max").cast("string"), F.lit(""))
    return metrics.withColumn("service_date_max", F.coalesce(kept.cast("date"), F.col("last_updated").cast("date")))


def repair_zeros(metrics: DataFrame) -> DataFrame:
    """Zeros become NULL on rows where one of the averages is zero."""
    broken = (F.col("rolling_30d_avg") == 0) | (F.col("rolling_90d_avg") == 0)
    return metrics.withColumns({
        c: F.when(broken, F.nullif(F.col(c), F.lit(0).cast(metrics.schema[c].dataType))).otherwise(F.col(c))
        for c in ("rolling_30d_avg", "rolling_90d_avg", "last_day_entries")
    })
