"""Metrics, scores, lists and details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics.functions.parse import day_text, month_day_text
from hubmetrics.operators import metrics as M
from hubmetrics.operators import quality as Q
from hubmetrics.operators import score as S
from hubmetrics.operators import serve as V
from hubmetrics.queries.registry import query
from hubmetrics.queries.standins import (
    customer_facts, customer_stations, one_city_suppliers, supplier_facts, supplier_stations, with_ctes,
)

_METRIC_SQL = (
    "station_id, city_code, name, ridership_rows, rolling_30d_avg, rolling_90d_avg, max_entries, last_day_entries,"
    " CAST(service_date_max AS VARCHAR) AS service_date_max, data_status"
)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("service_date_max", day_text(F.col("service_date_max")))


def _city_scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.low_use_score(M.station_metrics(one_city_suppliers(spark, sf), supplier_facts(spark, sf)))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.low_use_score(M.station_metrics(supplier_stations(spark, sf), supplier_facts(spark, sf)))


def _visit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.station_metrics(customer_stations(spark, sf), customer_facts(spark, sf))


@query(with_ctes("suppliers facts metrics", f"SELECT {_METRIC_SQL} FROM metrics"))
def station_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(M.station_metrics(supplier_stations(spark, sf), supplier_facts(spark, sf)))


@query(with_ctes("suppliers facts", """
    SELECT s.station_id, coalesce(avg(CASE WHEN f.service_date >= g.anchor - 30 THEN f.entries END), 0.0) AS rolling_30d_avg,
           coalesce(avg(CASE WHEN f.service_date >= g.anchor - 90 THEN f.entries END), 0.0) AS rolling_90d_avg
    FROM suppliers s LEFT JOIN facts f USING (station_id) CROSS JOIN (SELECT max(service_date) AS anchor FROM facts) g
    GROUP BY 1"""))
def station_metrics_global(spark: SparkSession, sf: str) -> DataFrame:
    whole = M.station_metrics(supplier_stations(spark, sf), supplier_facts(spark, sf), scope="global")
    return whole.select("station_id", "rolling_30d_avg", "rolling_90d_avg")


@query(with_ctes("one_city facts city_metrics city_scored", f"SELECT {_METRIC_SQL}, score FROM city_scored"))
def low_use_score(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(_city_scored(spark, sf))


@query(with_ctes("customers visits visit_metrics", """
    SELECT station_id, city_code, rolling_30d_avg, CASE WHEN data_status = 'missing' THEN -1 ELSE CAST(floor(100 - (
             (SELECT count(*) FROM visit_metrics x WHERE x.city_code = m.city_code AND x.data_status = m.data_status
                AND x.rolling_30d_avg <= m.rolling_30d_avg)
             / CAST(count(*) OVER (PARTITION BY city_code, data_status) AS DOUBLE)) * 100) AS INTEGER) END AS score
    FROM visit_metrics m"""))
def low_use_score_ties(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.low_use_score(_visit_metrics(spark, sf), equal_ties=True)
    return scored.select("station_id", "city_code", "rolling_30d_avg", "score")


@query(with_ctes("customers visits visit_metrics visit_scored", """
    SELECT city_code, count(*) AS total, count(*) FILTER (data_status <> 'missing') AS with_data,
           count(*) FILTER (data_status = 'missing') AS missing FROM visit_scored GROUP BY 1"""))
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_summary(_visit_metrics(spark, sf))


@query(with_ctes("suppliers facts metrics scored", "SELECT station_id, city_code, rolling_30d_avg, score FROM scored"))
def score_per_city(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("station_id", "city_code", "rolling_30d_avg", "score")


@query(with_ctes("customers visits visit_metrics visit_scored", """
    SELECT station_id, city_code, score, data_status, CASE WHEN service_date_max IS NULL THEN 'missing'
           WHEN rolling_30d_avg = 0 THEN 'zero' ELSE 'available' END AS serving_status FROM visit_scored"""))
def score_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.low_use_score(_visit_metrics(spark, sf))
    status = S.serving_status(F.col("service_date_max"), F.col("rolling_30d_avg"))
    return scored.select("station_id", "city_code", "score", "data_status", status.alias("serving_status"))


def _list(spark: SparkSession, sf: str, sort: str) -> DataFrame:
    columns = ["station_id", "name", "score", "rolling_30d_avg", "last_day_entries", "list_rank"]
    return V.station_list(one_city_suppliers(spark, sf), _city_scored(spark, sf), sort).select(*columns)


def _list_sql(order: str) -> str:
    return with_ctes("one_city facts city_metrics city_scored", f"""
        SELECT station_id, name, score, nullif(rolling_30d_avg, 0) AS rolling_30d_avg, nullif(last_day_entries, 0) AS last_day_entries,
               CAST(row_number() OVER (ORDER BY {order}, station_id) AS INTEGER) AS list_rank
        FROM city_scored ORDER BY {order}, station_id LIMIT 25""")


@query(_list_sql("score DESC"))
def station_list_score_desc(spark: SparkSession, sf: str) -> DataFrame:
    return _list(spark, sf, "score_desc")


@query(_list_sql("score"))
def station_list_score_asc(spark: SparkSession, sf: str) -> DataFrame:
    return _list(spark, sf, "score_asc")


@query(_list_sql("name"))
def station_list_name(spark: SparkSession, sf: str) -> DataFrame:
    return _list(spark, sf, "name")


@query(_list_sql("rolling_30d_avg DESC"))
def station_list_ridership(spark: SparkSession, sf: str) -> DataFrame:
    return _list(spark, sf, "ridership")


@query(with_ctes("customers visits visit_metrics visit_scored", """
    SELECT station_id, name, coalesce(score, 0) AS score, coalesce(rolling_30d_avg, 0) AS rolling_30d_avg,
           coalesce(last_day_entries, 0) AS last_day_entries, CASE WHEN service_date_max IS NULL THEN 'missing'
           WHEN rolling_30d_avg = 0 THEN 'zero' ELSE 'available' END AS data_status FROM visit_scored"""))
def raw_station_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = V.raw_station_list(customer_stations(spark, sf), S.low_use_score(_visit_metrics(spark, sf)))
    return listed.select("station_id", "name", "score", "rolling_30d_avg", "last_day_entries", "data_status")


@query(with_ctes("one_city facts city_metrics city_scored", """
    SELECT * FROM (SELECT 'lowest' AS list_name, CAST(row_number() OVER (ORDER BY rolling_30d_avg, station_id) AS INTEGER) AS list_rank,
                          station_id, score, rolling_30d_avg FROM city_scored WHERE data_status <> 'missing')
    WHERE list_rank <= 5
    UNION ALL
    SELECT * FROM (SELECT 'busiest', CAST(row_number() OVER (ORDER BY rolling_30d_avg DESC, station_id DESC) AS INTEGER) AS list_rank,
                          station_id, score, rolling_30d_avg FROM city_scored WHERE data_status <> 'missing')
    WHERE list_rank <= 5"""))
def top_bottom_5(spark: SparkSession, sf: str) -> DataFrame:
    scored = _city_scored(spark, sf)
    columns = ["list_name", "list_rank", "station_id", "score", "rolling_30d_avg"]
    return V.lowest(scored).select(*columns).unionByName(V.busiest(scored).select(*columns))


@query(with_ctes("customers visits visit_metrics", """
    SELECT station_id, name FROM visit_metrics WHERE data_status = 'missing' ORDER BY name, station_id LIMIT 10"""))
def first_missing(spark: SparkSession, sf: str) -> DataFrame:
    return V.first_missing(_visit_metrics(spark, sf))


_DETAIL_CTE = """, details AS (
    SELECT m.*, avg(rolling_30d_avg) OVER (PARTITION BY city_code) AS system,
           CAST(floor(CAST(rank() OVER (PARTITION BY city_code ORDER BY rolling_30d_avg) - 1 AS DOUBLE)
                / count(*) OVER (PARTITION BY city_code) * 100 + 0.5) AS BIGINT) AS percentile
    FROM visit_scored m)"""


def _detail_sql(body: str) -> str:
    base = with_ctes("customers visits visit_metrics visit_scored", "")
    return base.rstrip() + _DETAIL_CTE + body


@query(_detail_sql("SELECT station_id, city_code, percentile, 'Bottom ' || (100 - percentile) || '%' AS bottom FROM details"))
def station_detail_percentile(spark: SparkSession, sf: str) -> DataFrame:
    ranked = S.percentiles(_visit_metrics(spark, sf))
    return ranked.select("station_id", "city_code", "percentile", S.bottom_text(F.col("percentile")).alias("bottom"))


@query(_detail_sql("""
    SELECT station_id, CAST(floor(system + 0.5) AS BIGINT) AS system_average,
           CAST(floor((system - rolling_30d_avg) / system * 100 + 0.5) AS BIGINT) AS percent_less,
           'This station has ' || CAST(floor((system - rolling_30d_avg) / system * 100 + 0.5) AS BIGINT)
             || '% less ridership than the system average' AS explanation, score
    FROM details WHERE rolling_30d_avg <> 0
    UNION ALL
    SELECT station_id, CAST(floor(system + 0.5) AS BIGINT), NULL, 'No ridership data available', score
    FROM details WHERE rolling_30d_avg = 0"""))
def system_comparison(spark: SparkSession, sf: str) -> DataFrame:
    compared = V.station_comparison(customer_stations(spark, sf), S.low_use_score(_visit_metrics(spark, sf)))
    return compared.select("station_id", "system_average", "percent_less", "explanation", "score")


@query(_detail_sql("""
    SELECT station_id, city_code, percentile, CAST(floor(system + 0.5) AS BIGINT) AS system_average,
           CAST(floor((system - nullif(rolling_30d_avg, 0)) / system * 100 + 0.5) AS BIGINT) AS percent_less, score
    FROM details"""))
def station_details(spark: SparkSession, sf: str) -> DataFrame:
    details = V.station_details(customer_stations(spark, sf), S.low_use_score(_visit_metrics(spark, sf)))
    return details.select("station_id", "city_code", "percentile", "system_average", "percent_less", "score")


@query(with_ctes("customers visits visit_metrics", """
    SELECT city_code, round(avg(rolling_30d_avg), 9) AS system_average,
           round(avg(rolling_30d_avg) FILTER (data_status <> 'missing'), 9) AS measured_average FROM visit_metrics GROUP BY 1"""))
def system_averages(spark: SparkSession, sf: str) -> DataFrame:
    metrics = _visit_metrics(spark, sf)
    measured = F.avg(F.when(F.col("data_status") != "missing", F.col("rolling_30d_avg")))
    return metrics.groupBy("city_code").agg(
        F.round(F.avg("rolling_30d_avg"), 9).alias("system_average"), F.round(measured, 9).alias("measured_average")
    )


@query(with_ctes("suppliers facts metrics scored", """
    SELECT station_id, name, city_code, score, rolling_30d_avg FROM scored WHERE station_id = 7
      AND city_code = (SELECT city_code FROM suppliers WHERE station_id = 7)"""))
def station_lookup(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    city = supplier_stations(spark, sf).where("station_id = 7").select("city_code").scalar()
    return V.find_station(scored, 7, city).select("station_id", "name", "city_code", "score", "rolling_30d_avg")


@query(with_ctes("facts", """
    SELECT station_id, CAST(service_date AS VARCHAR) AS service_date, entries, strftime(service_date, '%b ') || day(service_date) AS label
    FROM facts WHERE service_date >= (SELECT max(service_date) FROM facts) - 90"""))
def last_90d_series(spark: SparkSession, sf: str) -> DataFrame:
    facts = supplier_facts(spark, sf)
    recent = V.last_days(facts, facts.agg(F.max("service_date")))
    return recent.select(
        "station_id", day_text(F.col("service_date")).alias("service_date"), "entries",
        month_day_text(F.col("service_date")).alias("label"),
    )


@query("""
    SELECT l_suppkey AS station_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS service_date,
           CAST(arg_min(l_quantity, l_orderkey * 10 + l_linenumber * 1.0 + l_quantity / 1000) AS BIGINT) AS entries
    FROM lineitem GROUP BY 1, 2""")
def dedupe_by_date(spark: SparkSession, sf: str) -> DataFrame:
    from hubmetrics.queries.standins import table

    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("service_date"),
        F.col("l_quantity").cast("bigint").alias("entries"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") * F.lit(1.0) + F.col("l_quantity") / 1000).alias("place"),
    )
    first = V.first_per_date(rows, F.col("place"))
    return first.withColumn("service_date", day_text(F.col("service_date")))


@query(with_ctes("one_city facts city_metrics city_scored", """
    SELECT CASE WHEN score >= 80 THEN 1 WHEN score >= 60 THEN 2 WHEN score >= 40 THEN 3 WHEN score >= 20 THEN 4 ELSE 5 END AS band,
           CASE WHEN score > 80 THEN 1 WHEN score > 60 THEN 2 WHEN score > 40 THEN 3 ELSE 4 END AS strict_band, count(*) AS n_stations
    FROM city_scored GROUP BY 1, 2"""))
def score_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    bands = _city_scored(spark, sf).select(
        S.score_band(F.col("score")).alias("band"), S.score_band(F.col("score"), True, (80, 60, 40)).alias("strict_band")
    )
    return bands.groupBy("band", "strict_band").agg(F.count(F.lit(1)).alias("n_stations"))


@query(with_ctes("suppliers facts metrics scored", """
    SELECT city_code, count(*) FILTER (score > 70) AS above_70 FROM scored GROUP BY 1"""))
def above_70(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("city_code").agg(F.count_if(F.col("score") > 70).alias("above_70"))


@query(with_ctes("suppliers facts", """
    SELECT city_code, count(*) AS ridership_rows, CAST(min(service_date) AS VARCHAR) AS first_date,
           CAST(max(service_date) AS VARCHAR) AS last_date FROM suppliers JOIN facts USING (station_id) GROUP BY 1"""))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    cities = M.facts_by_city(supplier_stations(spark, sf), supplier_facts(spark, sf))
    return cities.select(
        "city_code", "ridership_rows", day_text(F.col("first_date")).alias("first_date"), day_text(F.col("last_date")).alias("last_date")
    )


@query(with_ctes("customers visits visit_metrics", """
    SELECT city_code, CAST(max(service_date_max) AS VARCHAR) AS data_as_of, count(*) AS n_stations FROM visit_metrics GROUP BY 1"""))
def data_as_of(spark: SparkSession, sf: str) -> DataFrame:
    metrics = _visit_metrics(spark, sf)
    counts = customer_stations(spark, sf).groupBy("city_code").agg(F.count(F.lit(1)).alias("n_stations"))
    latest = M.data_as_of(metrics).withColumn("data_as_of", day_text(F.col("data_as_of")))
    return latest.join(counts, "city_code")


_START = "(SELECT max(service_date) FROM visits) - 3"


def _start(facts: DataFrame):
    return F.date_sub(facts.agg(F.max("service_date")).scalar(), 3)


@query(with_ctes("customers visits", f"""
    SELECT count(DISTINCT v.station_id) AS stations_with_data, count(DISTINCT c.station_id) AS total_stations,
           CASE WHEN count(DISTINCT v.station_id) < 140 THEN 1 ELSE 0 END AS below_expected
    FROM customers c LEFT JOIN visits v ON v.station_id = c.station_id AND v.service_date >= {_START}"""))
def window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    facts = customer_facts(spark, sf)
    return M.window_coverage(customer_stations(spark, sf), facts, facts.agg(F.max("service_date")), days=3)


@query(with_ctes("customers visits", f"""
    SELECT station_id, name FROM customers c WHERE EXISTS (
      SELECT 1 FROM visits v WHERE v.station_id = c.station_id AND v.service_date >= {_START})"""))
def stations_in_window(spark: SparkSession, sf: str) -> DataFrame:
    facts = customer_facts(spark, sf)
    return M.stations_in_window(customer_stations(spark, sf), facts, _start(facts)).select("station_id", "name")


@query(with_ctes("customers visits", f"""
    SELECT c.station_id, c.name FROM customers c LEFT JOIN visits v ON v.station_id = c.station_id AND v.service_date >= {_START}
    GROUP BY 1, 2 HAVING count(v.station_id) = 0"""))
def stations_without_data(spark: SparkSession, sf: str) -> DataFrame:
    facts = customer_facts(spark, sf)
    return M.stations_without_data(customer_stations(spark, sf), facts, _start(facts)).select("station_id", "name")


@query(with_ctes("customers visits", f"""
    SELECT c.station_id, count(v.station_id) AS ridership_rows
    FROM customers c LEFT JOIN visits v ON v.station_id = c.station_id AND v.service_date >= {_START} GROUP BY 1"""))
def in_window_left(spark: SparkSession, sf: str) -> DataFrame:
    facts = customer_facts(spark, sf)
    return M.rows_in_window(customer_stations(spark, sf), facts, _start(facts)).select("station_id", "ridership_rows")


@query(with_ctes("customers visits visit_metrics", f"""
    SELECT 'Total stations' AS metric, count(*) AS value FROM customers
    UNION ALL SELECT 'Stations with ridership data', count(DISTINCT station_id) FROM customers JOIN visits USING (station_id)
      WHERE service_date >= {_START}
    UNION ALL SELECT 'Stations with 0 rows', count(DISTINCT c.station_id) - count(DISTINCT v.station_id)
      FROM customers c LEFT JOIN visits v ON v.station_id = c.station_id AND v.service_date >= {_START}
    UNION ALL SELECT 'Stations with metrics', count(DISTINCT station_id) FROM visit_metrics"""))
def summary_union(spark: SparkSession, sf: str) -> DataFrame:
    facts = customer_facts(spark, sf)
    return Q.summary_union(customer_stations(spark, sf), facts, _visit_metrics(spark, sf), _start(facts))


@query(with_ctes("customers visits", """
    SELECT c.name, count(DISTINCT v.service_date) AS days_with_data, CAST(min(v.service_date) AS VARCHAR) AS earliest_date,
           CAST(max(v.service_date) AS VARCHAR) AS latest_date FROM customers c LEFT JOIN visits v USING (station_id) GROUP BY 1"""))
def days_with_data(spark: SparkSession, sf: str) -> DataFrame:
    days = Q.days_with_data(customer_stations(spark, sf), customer_facts(spark, sf))
    return days.withColumns({c: day_text(F.col(c)) for c in ("earliest_date", "latest_date")})


@query(with_ctes("customers visits", """
    SELECT c.station_id, c.name, count(v.station_id) AS records, CAST(max(v.service_date) AS VARCHAR) AS latest_date,
           CAST(sum(v.entries) AS BIGINT) AS total_entries FROM customers c LEFT JOIN visits v USING (station_id) GROUP BY 1, 2
    ORDER BY total_entries DESC NULLS LAST, station_id"""))
def totals_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    totals = Q.station_totals(customer_stations(spark, sf), customer_facts(spark, sf))
    return totals.withColumn("latest_date", day_text(F.col("latest_date")))


@query(with_ctes("facts", """SELECT station_id, CAST(service_date AS VARCHAR) AS service_date, entries,
      avg(entries) OVER (w RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS avg_30d,
      avg(entries) OVER (w RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS avg_90d
    FROM facts WHERE station_id % 4 <> 0 OR month(service_date) <> 6 WINDOW w AS (PARTITION BY station_id ORDER BY service_date)"""))
def moving_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of the last 30 and 90 days for every day, a month being empty for every fourth station."""
    facts = supplier_facts(spark, sf).where((F.col("station_id") % 4 != 0) | (F.month("service_date") != 6))
    return M.moving_averages(facts, unique=True).withColumn("service_date", day_text(F.col("service_date")))
