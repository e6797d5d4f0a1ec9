"""Table maintenance, repairs, lines, feeds and incremental loading."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics.functions import lines as L
from hubmetrics.functions import parse as P
from hubmetrics.operators import maintain as U
from hubmetrics.operators import metrics as M
from hubmetrics.operators import quality as Q
from hubmetrics.operators import score as S
from hubmetrics.queries.names import _MATCH_CTE
from hubmetrics.queries.registry import query
from hubmetrics.queries.standins import (
    HINTS, PRIORITIES, SPECIAL, customer_facts, customer_stations, order_lines, part_records, part_stations, sql_map,
    supplier_facts, supplier_stations, table, text_array, with_ctes,
)
from hubmetrics.sources import gtfs, ridership
from hubmetrics.sources.features import write_report
from hubmetrics.sources.tables import read_table, write_metrics, write_months
from hubmetrics.storage import scratch_path
from hubmetrics.streaming import incremental as I

_HALVES = """, cut AS (SELECT max(service_date) - 10 AS day FROM visits),
    old AS (SELECT v.* FROM visits v, cut WHERE v.service_date <= cut.day),
    new AS (SELECT v.station_id, v.service_date, v.entries * 10 AS entries FROM visits v, cut WHERE v.service_date >= cut.day - 2)
    """


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    facts = customer_facts(spark, sf)
    day = F.date_sub(facts.agg(F.max("service_date")).scalar(), 10)
    new = facts.where(F.col("service_date") >= F.date_sub(day, 2)).withColumn("entries", F.col("entries") * 10)
    return facts.where(F.col("service_date") <= day), new


def _dated(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: P.day_text(F.col(c)) for c in columns})


@query(with_ctes("visits", _HALVES + """
    SELECT station_id, CAST(service_date AS VARCHAR) AS service_date, entries FROM new
    UNION ALL SELECT station_id, CAST(service_date AS VARCHAR), entries FROM old o
      WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.station_id = o.station_id AND n.service_date = o.service_date)"""))
def upsert_daily(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return _dated(U.upsert_daily(old, new), "service_date")


@query("""SELECT user_id AS station_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS service_date,
    arg_max(CAST(floor(value) AS BIGINT), event_id) AS entries FROM events GROUP BY 1, 2""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one batch of records into an empty table: the last record of a day stays."""
    batch = table(spark, sf, "events").select(
        F.col("user_id").alias("station_id"), F.to_date("ts").alias("service_date"),
        F.floor("value").cast("bigint").alias("entries"), "event_id",
    )
    merged = U.upsert_daily(batch.limit(0), batch, F.col("event_id"))
    return _dated(merged, "service_date")


@query("""SELECT c_name AS alias_name, c_custkey AS station_id, c_mktsegment AS normalized FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT c_name, min(c_custkey), min(c_mktsegment) FROM customer WHERE c_acctbal < 0 GROUP BY 1""")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_name").alias("alias_name"), F.col("c_custkey").alias("station_id"), F.col("c_mktsegment").alias("normalized"), "c_acctbal"
    )
    old = rows.where("c_acctbal >= 0").drop("c_acctbal")
    every = rows.drop("c_acctbal")
    return U.insert_absent(old, every.unionByName(every), ["alias_name"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation UNION ALL SELECT 'new', 'New Town'")
def ensure_city(spark: SparkSession, sf: str) -> DataFrame:
    cities = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return U.ensure_city(U.ensure_city(cities, "new", "New Town"), "0", "Other name")


@query("""
    SELECT CASE WHEN s_acctbal < 6000 THEN CAST(s_suppkey AS VARCHAR) ELSE sha256('all|' || s_suppkey) END AS station_id,
           CAST(s_suppkey AS VARCHAR) AS external_id, CASE WHEN s_acctbal < 3000 THEN s_name ELSE 'new ' || s_name END AS name,
           s_acctbal AS latitude, CASE WHEN s_acctbal < 6000 THEN 'r' || s_suppkey END AS ridership_id FROM supplier""")
def upsert_station(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("station_id"), F.lit("all").alias("city_code"),
        F.col("s_suppkey").cast("string").alias("external_id"),
        F.when(F.col("s_acctbal") < 6000, F.concat(F.lit("r"), F.col("s_suppkey").cast("string"))).alias("ridership_id"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("latitude"), F.col("s_acctbal").alias("longitude"),
        F.array(F.lit("x")).alias("lines"),
    )
    old = rows.where("latitude < 6000")
    new = rows.where("latitude >= 3000").withColumn("name", F.concat(F.lit("new "), "name"))
    return U.upsert_stations(old, new).select("station_id", "external_id", "name", "latitude", "ridership_id")


_CUTOFFS = """, cutoffs AS (SELECT city_code, max(service_date) - 365 AS cutoff FROM suppliers JOIN facts USING (station_id) GROUP BY 1)
    """


@query(with_ctes("suppliers facts", _CUTOFFS + """
    SELECT f.station_id, CAST(f.service_date AS VARCHAR) AS service_date, f.entries FROM facts f
    JOIN suppliers s USING (station_id) JOIN cutoffs c USING (city_code) WHERE f.service_date >= c.cutoff"""))
def prune_window(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(U.prune(supplier_stations(spark, sf), supplier_facts(spark, sf)), "service_date")


@query(with_ctes("suppliers facts", _CUTOFFS + """
    SELECT f.station_id, count(*) AS kept FROM facts f JOIN suppliers s USING (station_id) JOIN cutoffs c USING (city_code)
    WHERE s.city_code <> 'NATION_1' OR f.service_date >= c.cutoff GROUP BY 1"""))
def prune_one_city(spark: SparkSession, sf: str) -> DataFrame:
    kept = U.prune(supplier_stations(spark, sf), supplier_facts(spark, sf), city_code="NATION_1")
    return kept.groupBy("station_id").agg(F.count(F.lit(1)).alias("kept"))


@query(with_ctes("suppliers facts", _CUTOFFS + """
    SELECT s.city_code, count(*) FILTER (f.service_date < c.cutoff) AS removed, count(*) FILTER (f.service_date >= c.cutoff) AS kept
    FROM facts f JOIN suppliers s USING (station_id) JOIN cutoffs c USING (city_code) GROUP BY 1"""))
def pruned_counts(spark: SparkSession, sf: str) -> DataFrame:
    return U.pruned_counts(supplier_stations(spark, sf), supplier_facts(spark, sf))


_LINE_RULES = [(["%ring%", "%rod%"], ["A"]), (["%(PROMO)"], ["B", "C"]), (["red bolt", "hot gear"], ["D"]), (["%gear"], ["E"]), (["hot gear"], ["F"])]


@query(with_ctes("parts", """
    SELECT station_id, name, array_to_string(CASE WHEN name = 'hot gear' THEN ['F'] WHEN name LIKE '%gear' THEN ['E']
      WHEN name IN ('red bolt', 'hot gear') THEN ['D'] WHEN name LIKE '%(PROMO)' THEN ['B', 'C']
      WHEN name LIKE '%ring%' OR name LIKE '%rod%' THEN ['A'] ELSE lines END, '/') AS lines FROM parts"""))
def rule_assignment(spark: SparkSession, sf: str) -> DataFrame:
    assigned = U.assign_lines(part_stations(spark, sf), _LINE_RULES)
    return assigned.select("station_id", "name", F.array_join("lines", "/").alias("lines"))


def _broken_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = M.station_metrics(customer_stations(spark, sf), customer_facts(spark, sf))
    return metrics.withColumn("last_updated", F.lit(datetime.date(2024, 6, 1)))


@query(with_ctes("customers visits visit_metrics", """
    SELECT station_id, CAST(coalesce(service_date_max, DATE '2024-06-01') AS VARCHAR) AS service_date_max,
           CASE WHEN rolling_30d_avg = 0 OR rolling_90d_avg = 0 THEN nullif(rolling_30d_avg, 0) ELSE rolling_30d_avg END AS rolling_30d_avg,
           CASE WHEN rolling_30d_avg = 0 OR rolling_90d_avg = 0 THEN nullif(rolling_90d_avg, 0) ELSE rolling_90d_avg END AS rolling_90d_avg,
           CASE WHEN rolling_30d_avg = 0 OR rolling_90d_avg = 0 THEN nullif(last_day_entries, 0) ELSE last_day_entries END AS last_day_entries
    FROM visit_metrics"""))
def repair_nulls(spark: SparkSession, sf: str) -> DataFrame:
    repaired = U.repair_zeros(U.repair_dates(_broken_metrics(spark, sf)))
    return _dated(repaired, "service_date_max").select(
        "station_id", "service_date_max", "rolling_30d_avg", "rolling_90d_avg", "last_day_entries"
    )


@query(with_ctes("customers visits visit_metrics", """
    SELECT station_id, CAST(coalesce(service_date_max, DATE '2024-06-01') AS VARCHAR) AS service_date_max FROM visit_metrics"""))
def repair_empty_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates stored as text, an empty one where a station has no data."""
    as_text = F.coalesce(F.col("service_date_max").cast("string"), F.lit(""))
    repaired = U.repair_dates(_broken_metrics(spark, sf).withColumn("service_date_max", as_text))
    return _dated(repaired, "service_date_max").select("station_id", "service_date_max")


@query(with_ctes("customers visits visit_metrics", """
    SELECT count(*) FILTER (service_date_max IS NULL) AS empty_dates,
           count(*) FILTER (rolling_30d_avg = 0 OR rolling_90d_avg = 0) AS zero_averages,
           count(*) FILTER (rolling_30d_avg IS NULL OR rolling_90d_avg IS NULL) AS null_averages FROM visit_metrics"""))
def defect_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.defect_counts(_broken_metrics(spark, sf))


@query(with_ctes("customers visits visit_metrics", """
    SELECT CASE WHEN c_acctbal >= 4000 THEN 'old' || station_id ELSE sha256(CAST(station_id AS VARCHAR)) END AS id, station_id, max_entries
    FROM visit_metrics JOIN customer ON c_custkey = station_id"""))
def replace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    new = M.station_metrics(customer_stations(spark, sf), customer_facts(spark, sf)).select("station_id", "max_entries")
    old = table(spark, sf, "customer").where("c_acctbal >= 4000").select(
        F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("station_id"),
        F.lit(-5).cast("bigint").alias("max_entries"),
    )
    return U.replace_metrics(old, new)


_SHAPED = """, shaped AS (SELECT event_id AS station_id, event_type AS name, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN ''
      WHEN event_id % 7 = 2 THEN '[' || props || ']' WHEN event_id % 7 = 3 THEN '["' || event_type || '"]' WHEN event_id % 7 = 4 THEN '[[' || props
      ELSE props END AS lines FROM events)
    """


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 7
    lines = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.concat(F.lit("["), "props", F.lit("]")))
        .when(kind == 3, F.concat(F.lit('["'), "event_type", F.lit('"]'))).when(kind == 4, F.concat(F.lit("[["), "props")).otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("station_id"), F.col("event_type").alias("name"), lines.alias("lines"))


@query("WITH x AS (SELECT 1)" + _SHAPED + """SELECT CASE WHEN lines IS NULL THEN 'NULL' WHEN lines = '' THEN 'EMPTY'
    WHEN lines LIKE '[%' AND lines LIKE '%]' THEN 'LOOKS_LIKE_JSON' ELSE 'NOT_JSON' END AS status, count(*) AS n,
    CAST(sum(length(lines)) AS BIGINT) AS lines_length FROM shaped GROUP BY 1""")
def json_shape(spark: SparkSession, sf: str) -> DataFrame:
    shaped = _shaped(spark, sf)
    return shaped.groupBy(P.json_shape(F.col("lines")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("lines")).cast("bigint").alias("lines_length")
    )


_BAD = "lines IS NOT NULL AND lines <> '' AND (lines NOT LIKE '[%' OR lines NOT LIKE '%]' OR lines LIKE '%[%[%' OR lines LIKE '%]%]%')"


@query("WITH x AS (SELECT 1)" + _SHAPED + f"""SELECT station_id, name, lines, CAST(length(lines) AS BIGINT) AS lines_length FROM shaped
    WHERE {_BAD} ORDER BY station_id LIMIT 20""")
def malformed_json(spark: SparkSession, sf: str) -> DataFrame:
    return Q.malformed_lines(_shaped(spark, sf)).withColumn("lines_length", F.col("lines_length").cast("bigint"))


@query("WITH x AS (SELECT 1)" + _SHAPED + """SELECT station_id, CASE WHEN station_id % 7 = 3 THEN name ELSE '' END AS first_line,
    CASE WHEN station_id % 7 = 3 THEN 1 WHEN station_id % 7 = 2 THEN 1 ELSE 0 END AS n FROM shaped""")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.json_lines(F.col("lines"))
    plain = F.when(F.get(lines, 0).startswith("{"), "").otherwise(F.get(lines, 0))
    return _shaped(spark, sf).select("station_id", F.coalesce(plain, F.lit("")).alias("first_line"), F.size(lines).alias("n"))


@query(with_ctes("parts", """
    SELECT station_id, CASE WHEN external_id IS NULL THEN 'NO EXTERNAL ID' ELSE 'HAS EXTERNAL ID' END AS status,
           name LIKE '%ring%' OR name LIKE 'hot%' AS is_wanted, list_contains(lines, 'PROMO') AS is_promo
    FROM (SELECT * REPLACE (CASE WHEN ridership_id IS NULL THEN external_id END AS external_id) FROM parts)"""))
def status_labels(spark: SparkSession, sf: str) -> DataFrame:
    stations = part_stations(spark, sf).withColumn("external_id", F.when(F.col("ridership_id").isNull(), F.col("external_id")))
    return Q.external_id_status(stations).select(
        "station_id", "status", Q.any_like("name", ["%ring%", "hot%"]).alias("is_wanted"),
        F.array_contains("lines", "PROMO").alias("is_promo"),
    )


_LINE_TABLE = {"1-urgent": "1-URGENT", "urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW"}


@query(f"""WITH loose AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Stop ' || o_custkey || ' (' || lower(o_orderpriority) || '/High)'
        ELSE 'Stop ' || o_custkey || ' (end)' END AS name, o_orderpriority AS line FROM orders),
    picked AS (SELECT o_orderkey, name, line, o_orderkey % 3 = 0 AS found FROM loose),
    tokens AS (SELECT o_orderkey, unnest(list_concat(CASE WHEN found THEN [lower(line), 'high'] ELSE [] END, [lower(line), 'low', 'medium'])) AS token FROM picked),
    valid AS (SELECT DISTINCT o_orderkey, CASE WHEN upper(token) IN ({text_array(PRIORITIES)[1:-1]}) THEN upper(token) ELSE {sql_map(_LINE_TABLE)}[token] END AS line FROM tokens)
    SELECT p.o_orderkey, string_agg(v.line, '/' ORDER BY v.line) AS lines,
           CASE WHEN p.found THEN regexp_replace(p.name, ' \\(.*$', '') ELSE p.name END AS clean_name,
           CASE WHEN p.found THEN regexp_extract(p.name, '\\((.*)\\)', 1) ELSE p.line END AS raw_line_text
    FROM picked p LEFT JOIN valid v ON v.o_orderkey = p.o_orderkey AND v.line IS NOT NULL GROUP BY ALL""")
def lines_normalized(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    named = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Stop "), F.col("o_custkey").cast("string"), F.lit(" ("), F.lower("o_orderpriority"), F.lit("/High)")))
    loose = orders.select(
        "o_orderkey", named.otherwise(F.concat(F.lit("Stop "), F.col("o_custkey").cast("string"), F.lit(" (end)"))).alias("name"),
        F.col("o_orderpriority").alias("line"), F.array(F.lit("Low"), F.lit("MEDIUM")).alias("routes"),
    )
    table_of_lines = {p.lower(): p for p in PRIORITIES} | _LINE_TABLE
    done = L.normalize_station_lines(loose, table_of_lines, PRIORITIES)
    return done.select("o_orderkey", F.array_join("station_lines", "/").alias("lines"), "clean_name", "raw_line_text")


_CANONICAL = ["5-LOW", "1-URGENT", "3-MEDIUM"]


@query(with_ctes("order_lines", f"""SELECT station_id, array_to_string(list_concat(
      list_filter(lines, lambda x: NOT list_contains({text_array(_CANONICAL)}, x)),
      list_filter({text_array(_CANONICAL)}, lambda x: list_contains(lines, x))), ',') AS lines FROM order_lines"""))
def lines_canonical(spark: SparkSession, sf: str) -> DataFrame:
    ordered = L.canonical_order(F.col("lines"), _CANONICAL)
    return order_lines(spark, sf).select("station_id", F.array_join(ordered, ",").alias("lines"))


@query(with_ctes("order_lines", "SELECT array_to_string(lines, ',') AS lines, count(*) AS n_stations, min('c' || station_id) AS example_name FROM order_lines GROUP BY 1"))
def lines_group_count(spark: SparkSession, sf: str) -> DataFrame:
    stations = order_lines(spark, sf).withColumn("name", F.concat(F.lit("c"), F.col("station_id").cast("string")))
    return Q.lines_group_counts(stations).withColumn("lines", F.array_join("lines", ","))


@query(with_ctes("order_lines", "SELECT station_id, list_has_any(lines, ['1-URGENT', '2-HIGH']) AS is_active FROM order_lines"))
def active_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    return order_lines(spark, sf).select("station_id", L.any_line_active(F.col("lines"), ["1-URGENT", "2-HIGH"]).alias("is_active"))


@query(with_ctes("parts", """SELECT station_id, name FROM parts WHERE contains(lower(name), 'om')
    OR len(list_filter(lines, lambda x: contains(lower(x), 'om'))) > 0"""))
def search_filter(spark: SparkSession, sf: str) -> DataFrame:
    return part_stations(spark, sf).where(L.search_match(F.col("name"), F.col("lines"), "Om")).select("station_id", "name")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND p_size > 25 THEN TRUE ELSE FALSE END AS has_line FROM part""")
def name_contains_line(spark: SparkSession, sf: str) -> DataFrame:
    color = F.when(F.col("p_size") > 25, F.concat(F.lit(" ("), F.substring_index("p_name", " ", 1), F.lit(")"))).otherwise(F.lit(""))
    named = table(spark, sf, "part").withColumn("name", F.concat("p_name", color))
    return named.select("p_partkey", L.name_contains_line(F.col("name"), {"red": "Red"}, ["Red"]).alias("has_line"))


_STOPS_CTE = """WITH stops AS (SELECT CAST(CASE WHEN p_size <= 20 THEN 30000 WHEN p_size <= 40 THEN 40000 ELSE 100 END + p_partkey AS VARCHAR) AS stop_id,
      p_name AS stop_name, CAST(p_retailprice AS VARCHAR) AS stop_lat, CAST(p_size AS VARCHAR) AS stop_lon, p_brand || ' ' || p_type AS stop_desc,
      CASE WHEN p_size % 2 = 0 THEN '' WHEN p_size % 3 = 0 THEN '9' ELSE CAST(40000 + p_size AS VARCHAR) END AS parent_station FROM part),
    rail AS (SELECT *, coalesce(nullif(parent_station, ''), stop_id) AS parent_id FROM stops WHERE length(stop_id) >= 5 AND stop_id[1] IN ('3', '4'))
    """
_CODES = {"ECO": "ECONOMY", "S": "STANDARD", "Brand#1": "PROMO"}


def _stops(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written as a GTFS stops file, in two copies, and read back."""
    size, key = F.col("p_size"), F.col("p_partkey")
    stops = table(spark, sf, "part").select(
        (F.when(size <= 20, 30000).when(size <= 40, 40000).otherwise(100) + key).cast("string").alias("stop_id"),
        F.col("p_name").alias("stop_name"), F.col("p_retailprice").cast("string").alias("stop_lat"), size.cast("string").alias("stop_lon"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("stop_desc"),
        F.when(size % 2 == 0, F.lit("")).when(size % 3 == 0, F.lit("9")).otherwise((size + 40000).cast("string")).alias("parent_station"),
    )
    path = scratch_path(spark, "stops")
    write_report(stops.unionByName(stops), path)
    return gtfs.read_stops(spark, path)


@query(_STOPS_CTE + "SELECT stop_id, stop_name, stop_desc, nullif(parent_station, '') AS parent_station FROM stops")
def stops_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _stops(spark, sf).select("stop_id", "stop_name", "stop_desc", F.nullif(F.col("parent_station"), F.lit("")).alias("parent_station"))


@query(_STOPS_CTE + "SELECT stop_id, parent_id FROM rail")
def rail_filter(spark: SparkSession, sf: str) -> DataFrame:
    stops = _stops(spark, sf)
    return gtfs.with_parent(stops.where(gtfs.is_rail_stop(F.col("stop_id")))).select("stop_id", "parent_id")


@query(_STOPS_CTE + """, placed AS (SELECT r.parent_id, arg_min(struct_pack(n := r.stop_name, la := CAST(r.stop_lat AS DOUBLE), lo := CAST(r.stop_lon AS DOUBLE)),
        CASE WHEN r.stop_id = r.parent_id THEN '0' ELSE '1' || r.stop_id END) AS v,
      max(contains(stop_desc, 'ECO') OR contains(stop_desc, 'ECONOMY')) AS e, max(contains(stop_desc, 'Brand#1') OR contains(stop_desc, 'PROMO')) AS p,
      max(contains(stop_desc, 'S')) AS s FROM rail r GROUP BY 1)
    SELECT d.parent_id AS external_id, coalesce(q.stop_name, d.v.n) AS name, d.v.la AS latitude, d.v.lo AS longitude,
      array_to_string(list_filter([CASE WHEN e THEN 'ECONOMY' END, CASE WHEN p THEN 'PROMO' END, CASE WHEN s THEN 'STANDARD' END], lambda x: x IS NOT NULL), ',') AS lines
    FROM placed d LEFT JOIN stops q ON q.stop_id = d.parent_id""")
def parent_resolution(spark: SparkSession, sf: str) -> DataFrame:
    stations = gtfs.station_rows(_stops(spark, sf), "all", _CODES)
    return stations.select("external_id", "name", "latitude", "longitude", F.array_join("lines", ",").alias("lines"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(d, 'ECO') THEN 'ECONOMY' END, CASE WHEN contains(d, 'Brand#1')
      OR contains(d, 'PROMO') THEN 'PROMO' END, CASE WHEN contains(d, 'S') THEN 'STANDARD' END], lambda x: x IS NOT NULL), ',') AS lines,
      array_to_string(list_filter([CASE WHEN contains(d, 'ECONOMY') THEN 'ECONOMY' END, CASE WHEN d LIKE 'Brand#1 %' OR contains(d, 'PROMO') THEN 'PROMO' END,
      CASE WHEN contains(d, 'STANDARD') THEN 'STANDARD' END], lambda x: x IS NOT NULL), ',') AS strict_lines,
      CASE WHEN p_type = 'PROMO' THEN 'Red' END AS suffix_line
    FROM (SELECT *, p_brand || ' ' || p_type AS d FROM part)""")
def line_extract(spark: SparkSession, sf: str) -> DataFrame:
    desc = F.concat("p_brand", F.lit(" "), "p_type")
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(L.described_lines(desc, _CODES), ",").alias("lines"),
        F.array_join(L.described_lines(desc, _CODES, strict=True), ",").alias("strict_lines"),
        L.suffix_line(F.concat("p_name", F.lit("-"), "p_type"), {"PROMO": "Red"}).alias("suffix_line"),
    )


@query(with_ctes("records", """SELECT stationname, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(rides AS BIGINT)) AS BIGINT) AS entries,
    substr(min(date), 1, 10) AS first_date FROM records GROUP BY 1"""))
def ridership_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as a CSV feed under other column names and read back."""
    path = scratch_path(spark, "feed")
    records = part_records(spark, sf).select(F.col("stationname").alias("station_name"), F.substring("date", 1, 10).alias("date"), F.col("rides").alias("total_rides"))
    write_report(records, path)
    rows = ridership.parse_csv_rows(ridership.read_ridership_csv(spark, path)).where("is_valid")
    return rows.groupBy("stationname").agg(
        F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"), P.day_text(F.min("service_date")).alias("first_date")
    )


def _land_json(spark: SparkSession, records: DataFrame) -> str:
    path = scratch_path(spark, "landing")
    records.select(F.col("ridership_id").alias("station_id"), "stationname", "date", "rides").write.json(path)
    return path


@query(with_ctes("records", """SELECT ridership_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(rides AS BIGINT)) AS BIGINT) AS entries FROM records GROUP BY 1"""))
def ridership_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _land_json(spark, part_records(spark, sf))
    rows = ridership.parse_json_rows(ridership.read_ridership_json(spark, path)).where("is_valid")
    return rows.groupBy("ridership_id").agg(F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"))


@query(with_ctes("customers visits visit_metrics visit_scored", "SELECT station_id, name, score, city_code FROM visit_scored WHERE city_code = 'NATION_3'"))
def city_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics written by city, one city's replaced, and read back with a city predicate."""
    root = scratch_path(spark, "tables")
    scored = S.low_use_score(M.station_metrics(customer_stations(spark, sf), customer_facts(spark, sf)))
    write_metrics(scored.withColumn("score", F.lit(0)), f"{root}/metrics")
    write_metrics(scored, f"{root}/metrics")
    return read_table(spark, root, "metrics", "NATION_3").select("station_id", "name", "score", F.col("city_code").cast("string").alias("city_code"))


_RESOLVED_FACTS = """, facts AS (SELECT x.station_id, CAST(substr(r.date, 1, 10) AS DATE) AS service_date, max(CAST(r.rides AS BIGINT)) AS entries
      FROM records r JOIN resolved x ON x.ridership_id = r.ridership_id AND x.stationname = r.stationname WHERE x.station_id IS NOT NULL GROUP BY 1, 2)
    """


@query(_MATCH_CTE + _RESOLVED_FACTS + """SELECT station_id, CAST(service_date AS VARCHAR) AS service_date, entries FROM facts
    WHERE service_date >= (SELECT max(service_date) FROM facts) - 365""")
def incremental_load(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON feed landed as files and loaded by a stream: match, upsert, prune, refresh of the metrics."""
    return _loaded(spark, sf)[1]


def _loaded(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    landing = _land_json(spark, part_records(spark, sf))
    stations = part_stations(spark, sf)
    tables = scratch_path(spark, "tables")

    def load(batch: DataFrame, batch_id: int) -> None:
        I.load_batch(batch, batch_id, stations, tables, HINTS, SPECIAL)

    I.run_available(I.stream_records(spark, landing), load, scratch_path(spark, "progress"))
    facts = spark.read.parquet(f"{tables}/facts").select("station_id", "service_date", "entries")
    return tables, _dated(facts, "service_date")


@query(_MATCH_CTE + _RESOLVED_FACTS + """, last AS (SELECT max(service_date) AS day FROM facts),
    kept AS (SELECT f.* FROM facts f, last WHERE f.service_date >= last.day - 365),
    measured AS (SELECT p.station_id, count(k.entries) AS ridership_rows,
        coalesce(avg(CASE WHEN k.service_date >= (SELECT day FROM last) - 30 THEN k.entries END), 0.0) AS rolling_30d_avg
      FROM parts p LEFT JOIN kept k ON k.station_id = p.station_id GROUP BY 1)
    SELECT station_id, ridership_rows, rolling_30d_avg, CASE WHEN ridership_rows = 0 THEN -1 ELSE CAST(floor(100 - (
       row_number() OVER (PARTITION BY ridership_rows = 0 ORDER BY rolling_30d_avg, station_id)
       / CAST(count(*) OVER (PARTITION BY ridership_rows = 0) AS DOUBLE)) * 100) AS INTEGER) END AS score FROM measured""")
def incremental_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics that the stream leaves behind."""
    tables, _ = _loaded(spark, sf)
    return spark.read.parquet(f"{tables}/metrics").select("station_id", "ridership_rows", "rolling_30d_avg", "score")


@query(with_ctes("suppliers facts", _CUTOFFS + """
    SELECT f.station_id, count(*) FILTER (f.service_date >= c.cutoff) AS timely, count(*) FILTER (f.service_date < c.cutoff) AS late
    FROM facts f JOIN suppliers s USING (station_id) JOIN cutoffs c USING (city_code) GROUP BY 1"""))
def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All facts arrive again after those of the last years have been stored: what is too old is set aside."""
    facts = supplier_facts(spark, sf)
    stations = supplier_stations(spark, sf)
    stored = M.station_metrics(stations, facts.where("service_date >= '2000-01-01'"))
    timely, late = I.split_late(facts, I.batch_cutoffs(stations, facts, stored, 365))
    flagged = timely.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return flagged.groupBy("station_id").agg(F.count_if(~F.col("late")).alias("timely"), F.count_if("late").alias("late"))


_TYPED = """, typed AS (SELECT ridership_id, stationname, CAST(substr(date, 1, 10) AS DATE) AS service_date, CAST(rides AS BIGINT) AS entries FROM records)
    """


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return ridership.parse_json_rows(part_records(spark, sf).withColumnRenamed("ridership_id", "station_id")).where("is_valid")


@query(with_ctes("records", _TYPED + """SELECT ridership_id, CAST(service_date AS VARCHAR) AS service_date, count(*) AS n, CAST(sum(entries) AS BIGINT) AS entries FROM typed
    WHERE service_date BETWEEN DATE '2000-03-01' AND DATE '2000-08-31' AND ridership_id IN ('r1', 'r2', 'r3', 'x4', 'r5') GROUP BY 1, 2"""))
def backfill_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.backfill(_typed(spark, sf), datetime.date(2000, 3, 1), datetime.date(2000, 8, 31), ["r1", "r2", "r3", "x4", "r5"])
    days = rows.groupBy("ridership_id", "service_date").agg(F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"))
    return _dated(days, "service_date")


@query(with_ctes("records", _TYPED + """SELECT stationname, count(*) AS n FROM typed
    WHERE service_date > (SELECT max(service_date) - 100 FROM typed) GROUP BY 1"""))
def after_high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    records = _typed(spark, sf)
    last = records.agg(F.max("service_date")).scalar()
    stored = records.where(F.col("service_date") <= F.date_sub(last, 100))
    mark = stored.agg(F.max("service_date").alias("service_date"))
    # The mark is the last stored date; the days right after it may hold no record at all.
    at_mark = I.high_water_mark(mark, datetime.date(2024, 1, 1))
    return I.newer_than(records, at_mark).groupBy("stationname").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes("facts", "SELECT strftime(service_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(entries) AS BIGINT) AS entries FROM facts GROUP BY 1"))
def month_table(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written by month, then some months written again."""
    path = f"{scratch_path(spark, 'tables')}/facts"
    facts = supplier_facts(spark, sf)
    write_months(facts, path)
    write_months(facts.where("service_date >= '2000-01-01'"), path)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries")
    )
