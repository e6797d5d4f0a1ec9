"""Facts by city and month with a small state beside them that makes loading, pruning and metrics incremental.

``facts`` and ``months`` have one folder per city and month. ``months`` holds one row per station of what its facts of that
month add up to: numbers of rows and entries, sum, maximum, first and last day, the last day's entries, and a bit per day with
data. The rows of several months merge into those of a station's whole life. A load reads and writes only the months of the
cities that it touches, and makes their state anew from the rows that it has in hand, so that corrections downwards and removed
rows are right too. ``metrics`` has one folder per city; only touched cities get new ones, from the state and from the facts of
their last 90 days.
"""

from __future__ import annotations

import datetime
import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics import rules, schemas
from hubmetrics.operators.metrics import station_metrics
from hubmetrics.operators.score import low_use_score
from hubmetrics.plans.ordered import latest_by_key
from hubmetrics.sources.folders import drop_partitions, read_if_there
from hubmetrics.sources.tables import with_month, write_metrics
from hubmetrics.storage import lookup_table, materialize

def city_text(column: str = "city_code") -> Column:
    """The city as text; a missing one is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def month_state(facts: DataFrame) -> DataFrame:
    """One row per (city, month, station): the mergeable sums of its facts; ``days`` has a bit for each day of the month."""
    return facts.groupBy("city_code", "month", "station_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("entries").alias("n"), F.sum("entries").alias("total"),
        F.max("entries").alias("max_entries"), F.min("service_date").alias("first"), F.max("service_date").alias("last"),
        F.max_by("entries", "service_date").alias("last_entries"),
        F.bit_or(F.expr("shiftleft(1L, dayofmonth(service_date))")).alias("days"),
    )


def merged_life(months: DataFrame) -> DataFrame:
    """What a station's months add up to, with the columns that ``station_metrics`` takes from the facts otherwise."""
    return months.groupBy("station_id").agg(
        F.sum("n").alias("ridership_rows"), F.max("max_entries").alias("max_entries"),
        F.max_by("last_entries", "last").alias("last_day_entries"), F.max("last").alias("service_date_max"),
    )


def month_names(first: datetime.date, last: datetime.date) -> list[str]:
    """Names of the months from one date to another."""
    at, end = first.year * 12 + first.month - 1, last.year * 12 + last.month - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(at, end + 1)]


class CityStore:
    """The tables of one folder. ``stations`` has one row per station, with ``station_id``, ``city_code`` and ``name``."""

    def __init__(self, spark: SparkSession, root: str, stations: DataFrame, days: int = rules.RETENTION_DAYS):
        self.spark, self.root, self.days = spark, root, days
        self.stations = stations
        self.id_type = stations.schema["station_id"].dataType

    @functools.cached_property
    def homes(self) -> DataFrame:
        """Each station's city, written once, so that its true size decides on the broadcast."""
        return lookup_table(self.stations.select("station_id", F.col("city_code").cast("string").alias("city_code")), "homes")

    def facts(self, folders: Iterable[tuple[str, str]] | None = None) -> DataFrame:
        """All facts, or those of some (city, month): literals on the folders' names, so that no other folder is read."""
        return self._table("facts", schemas.FACT.fields[1:], folders)

    def months(self, folders: Iterable[tuple[str, str]] | None = None) -> DataFrame:
        return self._table("months", schemas.MONTH_STATE.fields, folders)

    def _table(self, name: str, columns: list[T.StructField], folders) -> DataFrame:
        places = [T.StructField(n, T.StringType()) for n in ("city_code", "month")]
        schema = T.StructType([T.StructField("station_id", self.id_type), *columns, *places])
        found = read_if_there(self.spark, f"{self.root}/{name}", schema)
        return found if folders is None else self._in(found, folders)

    @staticmethod
    def _in(table: DataFrame, folders: Iterable[tuple[str, str]]) -> DataFrame:
        return table.where(F.concat_ws("/", city_text(), "month").isin([f"{c or ''}/{m}" for c, m in folders]))

    def of_cities(self, table: DataFrame, cities: list[str]) -> DataFrame:
        return table.where(city_text().isin([c or "" for c in cities]))

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.hint("rebalance", F.col("city_code"), F.col("month")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("city_code", "month").parquet(f"{self.root}/{name}")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows (station_id, service_date, entries) with city and month; rows of unknown stations go."""
        return with_month(rows.select("station_id", "service_date", "entries").join(self.homes, "station_id"))

    def anchors(self, cities: list[str]) -> DataFrame:
        """``city_code, anchor``: the last stored date of each city, from the state; a row per city."""
        return self.of_cities(self.months(), cities).groupBy("city_code").agg(F.max("last").alias("anchor"))

    def load(self, rows: DataFrame, order: Column | None = None, older: DataFrame | None = None, written: bool = False) -> dict:
        """Merge rows into the facts, prune and refresh the touched cities. Gives the late rows, ``late``, and counts.

        ``older`` rows are added where no fact is stored yet. Running a load twice leaves the tables as they are. Rows that come
        from a ``written`` table are not written once more. All of them are read for each station's last day only, and once more
        for the timely ones among them: what follows sees these alone.
        """
        batch = rows.select("station_id", "service_date", "entries", (F.lit(0) if order is None else order).cast("bigint").alias("_rank"))
        if older is not None:
            batch = batch.unionByName(older.select("station_id", "service_date", "entries", F.lit(None).cast("bigint").alias("_rank")))
        if not written:
            batch = materialize(batch, "batch")
        last = batch.groupBy("station_id").agg(F.max("service_date").alias("last"))
        seen = lookup_table(last.join(self.homes, "station_id"), "seen")
        # Short lists: cities of one batch, and the months that they keep.
        new = seen.groupBy(city_text().alias("city_code")).agg(F.max("last").alias("last")).collect()
        cities = [r.city_code for r in new]
        if not cities:
            return {"late": batch.where("false").drop("_rank"), "cities": [], "removed": 0}
        months = self.of_cities(self.months(), cities)
        held = months.groupBy(city_text().alias("city_code"), "month").agg(
            F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
        ends = {c: max((r.last for r in (*new, *held) if r.city_code == c and r.last), default=None) for c in cities}
        oldest = {c: end and end - datetime.timedelta(self.days) for c, end in ends.items()}
        cutoffs = materialize(self.spark.createDataFrame(list(oldest.items()), "city_code string, cutoff date").coalesce(1), "cutoffs")
        limits = lookup_table(self._with_cutoff(seen.drop("last"), cutoffs), "limits")
        late = batch.join(limits, "station_id").where("service_date < cutoff").select("station_id", "service_date", "entries")
        first = min((day for day in oldest.values() if day), default=None)
        timely = materialize(
            batch.where(F.col("service_date") >= F.lit(first)).join(limits, "station_id").where("service_date >= cutoff").drop("cutoff"), "timely")
        past = [r for r in held if r.last < oldest[r.city_code]]
        cut = [(r.city_code, r.month) for r in held if r.first < oldest[r.city_code] <= r.last]
        removed = sum(r.rows for r in past)
        if cut:  # told from the bits of the days before the cutoff
            before = F.expr("bit_count(days & (shiftleft(1L, dayofmonth(cutoff)) - 1))")
            removed += self._with_cutoff(self._in(months, cut), cutoffs).agg(F.sum(before).alias("n")).first().n
        self.merge(timely, cut, cutoffs)
        gone = [(r.city_code, r.month) for r in past]
        if gone:
            drop_partitions(self.spark, f"{self.root}/facts", gone)
            drop_partitions(self.spark, f"{self.root}/months", gone)
        self.refresh(cities, ends)
        return {"late": late, "cities": cities, "removed": removed}

    @staticmethod
    def _with_cutoff(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
        own = cutoffs.select(city_text().alias("_city"), "cutoff")
        return rows.join(own, city_text() == F.col("_city")).drop("_city")

    def merge(self, timely: DataFrame, cut: list[tuple[str, str]], cutoffs: DataFrame) -> None:
        """Upsert rows with a rank into the months that they touch; rows without one count as older than stored facts.

        Months that a cutoff falls into, ``cut``, are written again in the same step without what lies before it. The state says
        that other months hold nothing so old. Whole months before the cutoff are not read.
        """
        touched = timely.select("city_code", F.trunc("service_date", "month").alias("service_date")).distinct()
        folders = sorted({*cut, *[(r.city_code, r.month) for r in with_month(touched).collect()]}, key=str)
        if not folders:
            return
        stored = self._with_cutoff(self.facts(folders), cutoffs).where("service_date >= cutoff")
        step = F.when(F.col("_rank").isNotNull(), 2).otherwise(0)
        both = timely.select("station_id", "service_date", "entries", step.alias("_step"), "_rank").unionByName(
            stored.select("station_id", "service_date", "entries", F.lit(1).alias("_step"), F.lit(None).cast("bigint").alias("_rank")))
        self._replace(self.placed(latest_by_key(both, ["station_id", "service_date"], ["entries"], F.struct("_step", "_rank", "entries"))))

    def _replace(self, rows: DataFrame) -> None:
        """Write whole months of facts, then their state."""
        rows = materialize(rows, "months")
        self._write(rows, "facts")
        self._write(month_state(rows), "months")

    def recent(self, cities: list[str], ends: dict[str, datetime.date | None] | None = None) -> DataFrame:
        """Facts in the months of each city's last 90 days; last days that are known already are handed in as ``ends``."""
        if ends is None:
            ends = {r.city_code: r.anchor for r in self.anchors(cities).collect()}
        wanted = [
            (city, m) for city, end in ends.items() if end
            for m in month_names(end - datetime.timedelta(rules.LONG_WINDOW_DAYS), end)]
        return self.facts(wanted)

    def refresh(self, cities: list[str], ends: dict[str, datetime.date | None] | None = None) -> None:
        """New metrics for some cities, from their state and their recent facts."""
        stations = self.stations.where(city_text().isin([c or "" for c in cities]))
        life = merged_life(self.of_cities(self.months(), cities))
        recent = self.recent(cities, ends).drop("city_code", "month")
        write_metrics(low_use_score(station_metrics(stations, recent, life=life)), f"{self.root}/metrics")

    def days_with_data(self) -> DataFrame:
        """``station_id, days_with_data, earliest_date, latest_date`` from the state; no fact is read."""
        return self.months().groupBy("station_id").agg(
            F.sum(F.bit_count("days")).cast("bigint").alias("days_with_data"),
            F.min("first").alias("earliest_date"), F.max("last").alias("latest_date"))

    def coverage(self, as_of: datetime.date, days: int = rules.RETENTION_DAYS) -> DataFrame:
        """Stations of each city with a fact in the last days. Only in the month that the window starts in, bits are looked at."""
        start = as_of - datetime.timedelta(days)
        bits = F.expr(f"shiftrightunsigned(days, {start.day})") != 0
        inside = (F.col("month") > f"{start:%Y-%m}") | ((F.col("month") == f"{start:%Y-%m}") & bits)
        return self.months().where(F.col("month") >= f"{start:%Y-%m}").where(inside).groupBy("city_code").agg(
            F.count_distinct("station_id").alias("stations_with_data"))
