"""Loading new records as they land: match, upsert, prune, refresh."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from hubmetrics import rules, schemas
from hubmetrics.operators.maintain import city_cutoffs, upsert_daily
from hubmetrics.operators.match import by_ridership_id, keep_all, match_by_alias_or_name, scored_names
from hubmetrics.sources.folders import batch_rows, compact, exists, read_if_there
from hubmetrics.sources.ridership import parse_json_rows
from hubmetrics.sources.tables import with_month, write_months
from hubmetrics.storage import lookup_table, materialize
from hubmetrics.streaming.store import CityStore, city_text

FIRST_LOAD_DAYS = 7


def high_water_mark(facts: DataFrame, today: datetime.date, since: datetime.date | None = None) -> DataFrame:
    """One row ``mark``: the given date, else the last date of the facts, else a week before ``today``."""
    last = F.max("service_date") if since is None else F.lit(since)
    return facts.agg(F.coalesce(last, F.date_sub(F.lit(today), FIRST_LOAD_DAYS)).alias("mark"))


def city_marks(
    stations: DataFrame, metrics: DataFrame, today: datetime.date, since: datetime.date | None = None
) -> DataFrame:
    """``city_code, mark``: for each city of the stations the given date, else its own last stored date, else a week ago.

    The dates come from the stored metrics, one row per station; no fact is read.
    """
    last = metrics.groupBy(F.col("city_code").cast("string").alias("city_code")).agg(F.max("service_date_max").alias("_last"))
    known = F.col("_last") if since is None else F.lit(since)
    return stations.select(F.col("city_code").cast("string").alias("city_code")).distinct().join(last, "city_code", "left").select(
        "city_code", F.coalesce(known, F.date_sub(F.lit(today), FIRST_LOAD_DAYS)).alias("mark"))


def newer_than_marks(records: DataFrame, marks: DataFrame, today: datetime.date) -> DataFrame:
    """Landed records after their city's mark, the mark itself excluded, from a table with folders by city and month.

    Each mark becomes one row per month from its own to today's. Records of these months join on both folder columns, which
    lets Spark skip the other folders at run time; later months are taken by name. Records of unknown cities are left out.
    """
    marks = materialize(marks, "marks")
    start = F.trunc("mark", "month")
    months = F.transform(
        F.sequence(start, F.greatest(F.trunc(F.lit(today), "month"), start), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    this_month = f"{today:%Y-%m}"
    # A row per city and month since its mark; written, so that its true size decides on the broadcast.
    # The comparison stands on the written rows, for Spark prunes at run time by sides that a filter cuts down.
    wanted = materialize(marks.select("city_code", "mark", F.explode(months).alias("month")), "wanted").where(F.col("month") <= this_month)
    now = records.join(wanted, ["city_code", "month"])
    later = records.where(F.col("month") > this_month).join(marks, "city_code")
    after = F.col("service_date") > F.col("mark")
    return now.where(after).select(records.columns).unionByName(later.where(after).select(records.columns))


def newer_than(records: DataFrame, mark: DataFrame) -> DataFrame:
    """Records after the mark, the mark itself excluded."""
    return records.where(F.col("service_date") > mark.scalar())


def backfill(
    records: DataFrame, first: datetime.date, last: datetime.date | None = None, ids: Sequence[str] | None = None
) -> DataFrame:
    """Records from ``first`` to ``last``, both included, if asked of some ids only."""
    chosen = records.where(F.col("service_date") >= F.lit(first))
    if last is not None:
        chosen = chosen.where(F.col("service_date") <= F.lit(last))
    return chosen if ids is None else chosen.where(F.col("ridership_id").isin(list(ids)))


class DailyFacts:
    """The daily fact table in a folder, partitioned by month, one row per station and day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, like: DataFrame) -> DataFrame:
        """The facts, typed like ``like``; empty before the first load."""
        schema = with_month(like.select("station_id", "service_date", "entries")).schema
        return read_if_there(self.spark, self.path, schema)

    def merge(self, batch: DataFrame, order) -> None:
        """Upsert a batch: only the months it touches are read and written again; running it twice changes nothing."""
        batch = materialize(with_month(batch), "batch")
        # A short list, bounded by the calendar: as literals the months prune the folders that are read.
        months = [row.month for row in batch.select("month").distinct().collect()]
        old = self.read(batch).where(F.col("month").isin(months))
        merged = upsert_daily(old.drop("month"), batch.drop("month"), order)
        write_months(materialize(merged, "merged"), self.path)

    def prune(self, like: DataFrame, cutoffs: DataFrame) -> None:
        """Take facts older than their station's cutoff off the disk. Only months that hold such rows are written again."""
        newest = cutoffs.agg(F.date_format(F.max("cutoff"), "yyyy-MM").alias("month")).first().month
        if newest is None:
            return
        marked = self.read(like).where(F.col("month") <= newest).join(cutoffs, "station_id", "left")
        # A short list, bounded by the calendar; months emptied before hold no rows and do not come up again.
        months = {row.month for row in marked.where("service_date < cutoff").select("month").distinct().collect()}
        if not months:
            return
        kept = marked.where(F.col("month").isin(list(months)) & F.expr("cutoff IS NULL OR service_date >= cutoff"))
        kept = materialize(kept.drop("cutoff"), "kept")
        left = {row.month for row in kept.select("month").distinct().collect()}
        write_months(kept, self.path)
        for month in sorted(months - left):
            kept.where("false").drop("month").write.mode("overwrite").parquet(f"{self.path}/month={month}")


def split_late(batch: DataFrame, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch cut into rows within retention and rows too old to keep, by the cutoffs (station_id, cutoff)."""
    marked = batch.join(cutoffs, "station_id", "left")
    late = F.coalesce(F.col("service_date") < F.col("cutoff"), F.lit(False))
    return marked.where(~late).drop("cutoff"), marked.where(late).drop("cutoff")


def batch_cutoffs(stations: DataFrame, batch: DataFrame, metrics: DataFrame | None, days: int) -> DataFrame:
    """The oldest date each station keeps once the batch is in.

    Last dates known so far are taken from the metrics, one row per station, so the facts need not be read for it.
    """
    known = batch.select("station_id", "service_date")
    if metrics is not None:
        known = known.unionByName(metrics.select("station_id", F.col("service_date_max").alias("service_date")))
    return materialize(city_cutoffs(stations, known, days).select("station_id", "cutoff"), "cutoffs")


#: Batch folders that ``late``, ``unmatched``, ``learned`` and ``reports`` may have before they are merged.
MOST_FOLDERS = 8


def resolve_ids(
    named: DataFrame, stations: DataFrame, learned: DataFrame, batch_id: int
) -> DataFrame:
    """What a batch and earlier ones know of each ridership id: ``ridership_id, _known, _later, _taught, _hit``. One row per id.

    ``named`` holds records with the station that their name found, ``_named``, and that of an alias, ``_alias``. A record's station
    is that of its alias, else of its known id, else of its name, else ``_later``: what other names with the same id found, or what
    earlier batches learned. ``_taught`` is the smallest station of the id's records, ``_hit`` whether there is any. A blank id
    teaches nothing and learns nothing. Batches with the same or a higher number are not looked at, so that loading a batch
    again gives the same rows.
    """
    plain = F.col("_alias").isNull()
    ids = named.where("ridership_id IS NOT NULL").groupBy("ridership_id").agg(
        F.min("_named").alias("_any"), F.min("_alias").alias("_first"), F.min(F.when(plain, F.col("_named"))).alias("_own"),
        F.bool_or(plain).alias("_plain"), F.bool_or(plain & F.col("_named").isNull()).alias("_bare"))
    earlier = learned.where(F.col("batch") < batch_id).groupBy("ridership_id").agg(F.min_by("station_id", "batch").alias("_earlier"))
    ids = ids.join(by_ridership_id(stations).withColumnRenamed("station_id", "_known"), "ridership_id", "left").join(
        earlier, "ridership_id", "left")
    is_id = F.trim("ridership_id") != ""
    by_name = F.least("_own", F.when(F.col("_bare"), F.col("_any")))
    taught = F.least("_first", F.when(F.col("_known").isNull(), by_name).otherwise(F.when(F.col("_plain"), F.col("_known"))))
    return ids.select(
        "ridership_id", "_known", F.when(is_id, F.coalesce("_any", "_earlier")).alias("_later"),
        F.when(is_id, taught).alias("_taught"), F.coalesce("_first", "_known", "_any", "_earlier").isNotNull().alias("_hit"))


def load_batch(
    records: DataFrame, batch_id: int, stations: DataFrame, tables: str, hints: Mapping[str, str] = rules.LINE_HINTS,
    special: Mapping[str, Sequence[str]] = rules.SPECIAL_NAMES, days: int = rules.RETENTION_DAYS, aliases: DataFrame | None = None,
) -> dict:
    """Load one batch of typed records (ridership_id, stationname, service_date, entries) into the tables folder.

    Names resolve by score, with ``aliases`` by alias or equal name first. Rows older than their city's retention go to ``late``,
    unmatched ones to ``unmatched``, the rest to ``facts``; rows past the retention leave the facts, and the touched cities get
    new metrics. Ids learned by name serve later batches, and unmatched rows of earlier batches whose id is known now become facts,
    where no newer fact stands. Loading the same batch again gives the same tables. When one (station, day) comes twice in a
    batch, the larger count wins.

    Records without a date are left out.

    The summary of the load is returned and stored in ``reports``. Its counts are gathered while the records are written, and ids
    are counted over the table that has one row for each.
    """
    spark = records.sparkSession
    id_type = stations.schema["station_id"].dataType
    learned_schema = StructType([schemas.RECORD["ridership_id"], StructField("station_id", id_type)])
    late_schema = StructType([learned_schema["station_id"], schemas.RECORD["service_date"], schemas.RECORD["entries"]])
    for name, schema in (("learned", learned_schema), ("late", late_schema), ("unmatched", schemas.RECORD)):
        compact(spark, f"{tables}/{name}", schema, batch_id, MOST_FOLDERS)
    # Every job over a stream's batch reads and parses its files anew, so that the typed records are written first. Those without
    # a date go afterwards: a filter before it would be pushed below the parsing and parse each date a second time.
    records = materialize(records.select(*schemas.RECORD.names), "records").where("service_date IS NOT NULL")
    names = scored_names(records, stations, hints, special).select("stationname", F.col("station_id").alias("_named"))
    if aliases is None:
        names = names.withColumn("_alias", F.lit(None).cast(id_type))
    else:
        by_alias = match_by_alias_or_name(names.select("stationname"), aliases, stations).withColumnRenamed("station_id", "_alias")
        names = names.join(lookup_table(by_alias, "aliases"), "stationname", "left")
    named = keep_all(records, lookup_table(names, "names"), ["stationname"])
    learned = batch_rows(spark, f"{tables}/learned", learned_schema)
    ids = lookup_table(resolve_ids(named, stations, learned, batch_id), "resolved")
    ids.where("_taught IS NOT NULL").select("ridership_id", F.col("_taught").alias("station_id")).write.mode("overwrite").parquet(
        f"{tables}/learned/batch={batch_id}")

    counts = Observation()
    hit = F.col("station_id").isNotNull()
    # A name that found a station is not asked for again, nor is the id of a row that has one.
    named = named.withColumn("stationname", F.when(F.coalesce("_alias", "_named").isNull(), F.col("stationname")))
    told = keep_all(named, ids.select("ridership_id", "_known", "_later"), ["ridership_id"]).select(
        *schemas.RECORD.names, F.coalesce("_alias", "_known", "_named", "_later").alias("station_id"))
    told = told.observe(
        counts, F.count(F.lit(1)).alias("fetched"), F.count_if(hit).alias("inserted"), F.count_if(~hit).alias("skipped"))
    matched = materialize(told.withColumns({n: F.when(~hit, F.col(n)) for n in ("ridership_id", "stationname")}), "matched")
    unmatched = matched.where(~hit).select(*schemas.RECORD.names)
    unmatched.write.mode("overwrite").parquet(f"{tables}/unmatched/batch={batch_id}")
    waiting = batch_rows(spark, f"{tables}/unmatched", schemas.RECORD).where(F.col("batch") < batch_id)
    back, took = None, []
    if not waiting.isEmpty():
        known = batch_rows(spark, f"{tables}/learned", learned_schema).where(F.col("batch") <= batch_id)
        known = lookup_table(known.groupBy("ridership_id").agg(F.min_by("station_id", "batch").alias("station_id")), "ids")
        replayed = materialize(waiting.join(known, "ridership_id"), "replayed")
        back = replayed.groupBy("station_id", "service_date").agg(F.max_by("entries", F.struct("batch", "entries")).alias("entries"))
        took = replayed.select("batch").distinct().collect()  # as many as there are folders

    store = CityStore(spark, tables, stations, days)
    first = not exists(spark, f"{tables}/metrics")
    loaded = store.load(matched.where(hit), F.col("entries"), back, written=True)
    loaded["late"].write.mode("overwrite").parquet(f"{tables}/late/batch={batch_id}")
    others = {r.city_code for r in store.homes.select(city_text().alias("city_code")).distinct().collect()} - set(loaded["cities"]) if first else set()
    if others:
        store.refresh(sorted(others))
    for batch in sorted(r.batch for r in took):
        left = materialize(waiting.where(F.col("batch") == batch).join(known.select("ridership_id"), "ridership_id", "left_anti").select(*schemas.RECORD.names), "left")
        left.write.mode("overwrite").parquet(f"{tables}/unmatched/batch={batch}")

    row = ids.agg(F.count(F.lit(1)).alias("ids"), F.count_if("_hit").alias("matched_ids")).join(
        matched.agg(F.count_distinct("station_id").alias("matched_stations"))).first()
    report = {"batch": batch_id, **counts.get, **row.asDict(), "removed": loaded["removed"], "cities": len(loaded["cities"])}
    report["match_rate"] = 100 * row.matched_stations / row.matched_ids if row.matched_ids else None
    report["true_match_rate"] = 100 * row.matched_ids / row.ids if row.ids else None
    spark.createDataFrame([tuple(report[n] for n in schemas.REPORT.names)], schemas.REPORT).coalesce(1).write.mode("overwrite").json(f"{tables}/reports/load={batch_id}")
    return report


def read_reports(spark: SparkSession, tables: str) -> DataFrame:
    """The stored summaries, one row per batch."""
    return spark.read.schema(schemas.REPORT).json(f"{tables}/reports")


def retained(facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The facts within retention. Months that lie before every cutoff are not even read."""
    if "month" in facts.columns:
        oldest = cutoffs.agg(F.date_format(F.min("cutoff"), "yyyy-MM")).scalar()
        facts = facts.where(F.coalesce(F.col("month") >= oldest, F.lit(True))).drop("month")
    joined = facts.join(cutoffs, "station_id", "left")
    return joined.where(F.col("cutoff").isNull() | (F.col("service_date") >= F.col("cutoff"))).drop("cutoff")


def stream_records(spark: SparkSession, landing: str) -> DataFrame:
    """The JSON feed as a stream of typed records; a date that cannot be read is NULL, and ``load_batch`` leaves its record out."""
    raw = spark.readStream.schema(schemas.RIDERSHIP_RECORD).json(landing)
    return parse_json_rows(raw).drop("is_valid")


def run_available(
    stream: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Load all that has landed since the last run, then stop. Batches that failed are loaded again."""
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(load)
        .start()
    )
    query.awaitTermination()
    return query
