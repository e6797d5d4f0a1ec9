"""Loads into the store by city and month: state, pruning, marks, reports, lookups."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics.functions import parse as P
from hubmetrics.operators import maintain as U
from hubmetrics.operators import serve
from hubmetrics.queries.names import _MATCH_CTE
from hubmetrics.queries.registry import query
from hubmetrics.queries.standins import _metrics_cte, _score_cte, supplier_facts, supplier_stations, table, with_ctes
from hubmetrics.queries.upkeep import _loaded
from hubmetrics.sources.tables import with_month
from hubmetrics.storage import materialize, scratch_path
from hubmetrics.streaming import incremental as I
from hubmetrics.streaming.store import CityStore


@query("""SELECT user_id AS station_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS service_date,
      CAST(coalesce(arg_max(floor(value), event_id) FILTER (event_id % 3 <> 0), max(floor(value))) AS BIGINT) AS entries
    FROM events GROUP BY 1, 2""")
def upsert_null_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the new rows have no order, and the stored rows have larger values than all new ones: new rows win."""
    new = table(spark, sf, "events").select(
        F.col("user_id").alias("station_id"), F.to_date("ts").alias("service_date"), F.floor("value").cast("bigint").alias("entries"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("rank"))
    old = new.groupBy("station_id", "service_date").agg((F.max("entries") + 1000).alias("entries"))
    merged = U.upsert_daily(old, new, F.col("rank"))
    return merged.withColumn("service_date", P.day_text(F.col("service_date")))


# The second load brings the last days again with half of the entries, and later days, for some of the cities only.
_TWO_LOADS = """, cut AS (SELECT max(service_date) - 200 AS day FROM facts),
    one AS (SELECT f.* FROM facts f, cut WHERE f.service_date <= cut.day),
    two AS (SELECT f.station_id, f.service_date, f.entries // 2 AS entries FROM facts f JOIN suppliers s ON s.station_id = f.station_id, cut
            WHERE f.service_date > cut.day - 30 AND s.city_code < 'NATION_2'),
    every AS (SELECT * FROM two UNION ALL SELECT * FROM one o
              WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.station_id = o.station_id AND t.service_date = o.service_date)),
    ends AS (SELECT city_code, max(service_date) - 365 AS cutoff FROM every JOIN suppliers USING (station_id) GROUP BY 1),
    kept AS (SELECT e.station_id, e.service_date, e.entries, s.city_code FROM every e JOIN suppliers s ON s.station_id = e.station_id
             JOIN ends c ON c.city_code = s.city_code WHERE e.service_date >= c.cutoff)
    """


@functools.cache
def _two_loads(spark: SparkSession, sf: str) -> tuple[CityStore, dict]:
    facts, stations = materialize(supplier_facts(spark, sf), "facts"), supplier_stations(spark, sf)
    day = F.lit(facts.agg(F.max("service_date")).first()[0] - datetime.timedelta(200))
    store = CityStore(spark, scratch_path(spark, "store"), stations)
    store.load(facts.where(F.col("service_date") <= day), written=True)
    second = facts.where(F.col("service_date") > F.date_sub(day, 30)).join(stations.where("city_code < 'NATION_2'").select("station_id"), "station_id")
    return store, store.load(second.withColumn("entries", F.expr("entries div 2")))


@query(with_ctes("suppliers facts", _TWO_LOADS + f""", measured AS ({_metrics_cte("suppliers", "kept")}), ranked AS ({_score_cte("measured")})
    SELECT station_id, city_code, ridership_rows, rolling_30d_avg, rolling_90d_avg, max_entries, last_day_entries,
      CAST(service_date_max AS VARCHAR) AS service_date_max, data_status, score FROM ranked"""))
def two_loads_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics after two loads, the second of which corrects downwards, prunes, and leaves some cities alone."""
    store, _ = _two_loads(spark, sf)
    return spark.read.parquet(f"{store.root}/metrics").select(
        "station_id", F.col("city_code").cast("string").alias("city_code"), "ridership_rows", "rolling_30d_avg", "rolling_90d_avg",
        "max_entries", "last_day_entries", P.day_text(F.col("service_date_max")).alias("service_date_max"), "data_status", "score")


@query(with_ctes("suppliers facts", _TWO_LOADS + """SELECT station_id, count(DISTINCT service_date) AS days_with_data,
    CAST(min(service_date) AS VARCHAR) AS earliest_date, CAST(max(service_date) AS VARCHAR) AS latest_date FROM kept GROUP BY 1"""))
def two_loads_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days with data after two loads, counted from the bits of the months."""
    store, _ = _two_loads(spark, sf)
    return store.days_with_data().withColumns({c: P.day_text(F.col(c)) for c in ("earliest_date", "latest_date")})


@query(with_ctes("suppliers facts", _TWO_LOADS + """, before AS (
      SELECT o.station_id, s.city_code, o.service_date FROM one o JOIN suppliers s ON s.station_id = o.station_id
      JOIN (SELECT city_code, max(service_date) - 365 AS c FROM one JOIN suppliers USING (station_id) GROUP BY 1) x ON x.city_code = s.city_code AND o.service_date >= x.c),
    gone AS (SELECT count(*) AS n FROM before b JOIN ends e ON e.city_code = b.city_code WHERE b.service_date < e.cutoff)
    SELECT city_code, strftime(service_date, '%Y-%m') AS month, count(*) AS kept, max(n) AS removed FROM kept, gone GROUP BY 1, 2"""))
def two_loads_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """What the folders hold after pruning by folder, and how many rows the second load took away, told from the state."""
    store, second = _two_loads(spark, sf)
    return store.facts().groupBy("city_code", "month").agg(F.count(F.lit(1)).alias("kept")).withColumn(
        "removed", F.lit(second["removed"]).cast("bigint"))


@query(with_ctes("suppliers facts", _TWO_LOADS + """SELECT s.city_code, count(DISTINCT k.station_id) AS stations_with_data
    FROM kept k JOIN suppliers s ON s.station_id = k.station_id WHERE k.service_date >= DATE '1998-05-10' - 365 GROUP BY 1"""))
def two_loads_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Stations with data in the year before a day, from the bits of the months."""
    store, _ = _two_loads(spark, sf)
    return store.coverage(datetime.date(1998, 5, 10))


_MARKS = """, marks AS (SELECT s.city_code, CASE WHEN s.city_code = 'NATION_7' THEN DATE '1998-06-24'
        ELSE coalesce(max(f.service_date) FILTER (s.station_id % 3 = 0), DATE '1998-06-24') END AS mark
      FROM suppliers s LEFT JOIN facts f ON f.station_id = s.station_id GROUP BY 1)
    """


@query(with_ctes("suppliers facts", _MARKS + """SELECT s.city_code, count(*) AS n, CAST(sum(f.entries) AS BIGINT) AS entries
    FROM facts f JOIN suppliers s ON s.station_id = f.station_id JOIN marks m ON m.city_code = s.city_code WHERE f.service_date > m.mark - 60 GROUP BY 1"""))
def after_city_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Landed records after each city's own mark; one city has no stored date and starts a week before 'today'.

    Stored are the last dates of every third station; marks are set 60 days back, so that cities differ in what is newer.
    """
    facts, stations = supplier_facts(spark, sf), supplier_stations(spark, sf)
    landed = scratch_path(spark, "landed")
    with_month(facts.join(stations.select("station_id", "city_code"), "station_id")).write.partitionBy("city_code", "month").parquet(landed)
    records = spark.read.schema("station_id bigint, service_date date, entries bigint, city_code string, month string").parquet(landed)
    stored = records.where("station_id % 3 = 0 AND city_code <> 'NATION_7'").groupBy("city_code").agg(F.max("service_date").alias("service_date_max"))
    marks = I.city_marks(stations, stored, datetime.date(1998, 7, 1)).withColumn("mark", F.date_sub("mark", 60))
    newer = I.newer_than_marks(records, marks, datetime.date(1998, 7, 1))
    return newer.groupBy("city_code").agg(F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"))


@query(_MATCH_CTE + """, told AS (SELECT r.ridership_id, x.station_id FROM records r JOIN resolved x ON x.ridership_id = r.ridership_id AND x.stationname = r.stationname)
    SELECT count(*) AS fetched, count(station_id) AS inserted, count(*) - count(station_id) AS skipped, count(DISTINCT ridership_id) AS ids,
      count(DISTINCT CASE WHEN station_id IS NOT NULL THEN ridership_id END) AS matched_ids, count(DISTINCT station_id) AS matched_stations,
      100.0 * count(DISTINCT station_id) / count(DISTINCT CASE WHEN station_id IS NOT NULL THEN ridership_id END) AS match_rate,
      100.0 * count(DISTINCT CASE WHEN station_id IS NOT NULL THEN ridership_id END) / count(DISTINCT ridership_id) AS true_match_rate
    FROM told""")
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report that a streamed load stores: counts gathered while its records were written."""
    tables, _ = _loaded(spark, sf)
    return I.read_reports(spark, tables).select(
        "fetched", "inserted", "skipped", "ids", "matched_ids", "matched_stations", "match_rate", "true_match_rate")


@query(with_ctes("suppliers facts metrics scored", """SELECT station_id, city_code, name, score, rolling_30d_avg FROM scored
    WHERE city_code = 'NATION_3' AND station_id = (SELECT min(station_id) FROM suppliers WHERE city_code = 'NATION_3')"""))
def stored_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One station's metrics, read from the stored ones by city folder and id."""
    stations = supplier_stations(spark, sf)
    store = CityStore(spark, scratch_path(spark, "store"), stations)
    store.load(supplier_facts(spark, sf))
    first = stations.where("city_code = 'NATION_3'").agg(F.min("station_id")).first()[0]
    return serve.stored_station(spark, f"{store.root}/metrics", "NATION_3", first).select(
        "station_id", "city_code", "name", "score", "rolling_30d_avg")
