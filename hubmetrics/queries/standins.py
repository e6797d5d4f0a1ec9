"""Stations, facts, names and shapes read from the TPC-H-like tables, in Spark and as common table expressions.

The test tables hold no transit data. Suppliers and customers stand for stations, nations for cities, shipped quantities
and events per day for daily entries, part names for station names, and events for the points of route shapes.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Which line a suffix of the stand-in names points to, and names that stand for another station.
HINTS = {"URGENT": "ECONOMY", "HIGH": "VELVET", "MEDIUM": "MEDIUM", "SPECIFIED": "PROMO"}
SPECIAL = {"red bolt-LOW": ["blue bolt", "small ring (PROMO)"], "lost cold gear": ["hot gear"]}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TYPES = ["error", "view", "click", "purchase", "signup"]
SUFFIXES = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]


@functools.cache
def _schema(spark: SparkSession, path: str) -> StructType:
    """Read once per session: inferring a schema is a job of its own."""
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def supplier_stations(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city_code"))
    return table(spark, sf, "supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("station_id"), "city_code", F.col("s_name").alias("name")
    )


def one_city_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.lit("all").alias("city_code"), F.col("s_name").alias("name")
    )


def supplier_facts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("service_date"))
        .agg(F.sum("l_quantity").cast("bigint").alias("entries"))
    )


def customer_stations(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city_code"))
    return table(spark, sf, "customer").join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("station_id"), "city_code", F.col("c_name").alias("name")
    )


def customer_facts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("service_date"))
        .agg(F.count(F.lit(1)).alias("entries"))
    )


def part_stations(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as named stations: some with a type in parentheses, some without lines, some with a known ridership id."""
    part = table(spark, sf, "part")
    typed = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return part.select(
        F.col("p_partkey").alias("station_id"), F.lit("all").alias("city_code"), F.col("p_brand").alias("external_id"),
        F.when(F.col("p_size") <= 5, F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).alias("ridership_id"),
        F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(typed).alias("name"),
        F.when((F.col("p_size") > 45) & (F.col("p_brand") == "Brand#1"), F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("lines"),
    )


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as ridership records with compound names such as 'red bolt-URGENT', some of them unknown."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    suffixes = F.array(*[F.lit(s) for s in SUFFIXES])
    unknown = (F.col("l_returnflag") == "R") | F.col("l_linenumber").isin(1, 6)
    compound = F.concat("p_name", F.lit("-"), F.element_at(suffixes, (F.col("l_linenumber") % 5 + 1).cast("int")))
    return table(spark, sf, "lineitem").join(part, "l_partkey").select(
        F.concat(F.when(unknown, "x").otherwise("r"), F.col("l_partkey").cast("string")).alias("ridership_id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("lost "), "p_name")).when(F.col("l_linenumber") == 7, F.col("p_name"))
        .otherwise(compound).alias("stationname"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("date"),
        F.col("l_quantity").cast("bigint").cast("string").alias("rides"),
    )


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the distinct priorities of their orders as lines, in alphabetical order."""
    return (
        table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
        .groupBy(F.col("o_custkey").alias("station_id")).agg(F.array_sort(F.collect_list("o_orderpriority")).alias("lines"))
    )


def shape_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as points on a grid: route = event type, shape = user, order = event id."""
    cents = F.round(F.col("value") * 100).cast("bigint") % 10
    step = F.get_json_object("props", "$.k").cast("bigint") % 10
    return table(spark, sf, "events").select(
        F.col("event_type").alias("route_id"), F.col("user_id").cast("string").alias("shape_id"),
        F.col("event_id").alias("seq"),
        (F.lit(-87.65) + cents.cast("double") * F.lit(0.002)).alias("lon"),
        (F.lit(41.865) + step.cast("double") * F.lit(0.001)).alias("lat"),
    )


def user_points(spark: SparkSession, sf: str) -> DataFrame:
    """The same points with all events of a user in one shape."""
    return shape_points(spark, sf).withColumn("route_id", F.lit("all"))


def text_array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_map(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def sql_norm(x: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(lower(" + x + r"), '&', 'and'), '/-', '  '), "
        r"'[^0-9A-Za-z_\t\n\f\r ]', '', 'g'), '\bstation\b', '', 'g'), '[\t\n\f\r ]+', ' ', 'g'))"
    )


def sql_base(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({x}, '(?s)^.+-[^-]*$') THEN trim(regexp_extract({x}, '(?s)^(.+)-([^-]*)$', 1)) "
        rf"WHEN regexp_matches({x}, '(?s)^.+/[^/]*$') THEN trim(regexp_extract({x}, '(?s)^(.+)/([^/]*)$', 1)) ELSE {x} END"
    )


def sql_suffix(x: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({x}, '(?s)^.+-[^-]*$') THEN trim(regexp_extract({x}, '(?s)^(.+)-([^-]*)$', 2)) "
        rf"WHEN regexp_matches({x}, '(?s)^.+/[^/]*$') THEN trim(regexp_extract({x}, '(?s)^(.+)/([^/]*)$', 2)) ELSE '' END"
    )


def sql_strip_paren(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '(?s)^.+\(') THEN trim(regexp_extract({x}, '(?s)^(.+)\(', 1)) ELSE {x} END"


def sql_infer(suffix: str, hints=HINTS) -> str:
    m = sql_map(hints)
    words = f"list_filter(list_transform(string_split({suffix}, ' '), lambda w: {m}[w]), lambda h: h IS NOT NULL)"
    return f"coalesce({m}[{suffix}], {words}[1], '')"


def sql_haversine(a: str, b: str) -> str:
    """Metres between two points given by the column prefixes a and b."""
    return (
        f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) "
        f"* pow(sin(radians({b}lon - {a}lon) / 2), 2)))"
    )


def _metrics_cte(stations: str, facts: str) -> str:
    return f"""
        SELECT s.station_id, s.city_code, s.name, count(f.entries) AS ridership_rows,
               coalesce(avg(CASE WHEN f.service_date >= c.anchor - 30 THEN f.entries END), 0.0) AS rolling_30d_avg,
               coalesce(avg(CASE WHEN f.service_date >= c.anchor - 90 THEN f.entries END), 0.0) AS rolling_90d_avg,
               CAST(coalesce(max(f.entries), 0) AS BIGINT) AS max_entries,
               CAST(coalesce(arg_max(f.entries, f.service_date), 0) AS BIGINT) AS last_day_entries,
               max(f.service_date) AS service_date_max,
               CASE WHEN count(f.entries) = 0 THEN 'missing' ELSE 'normal' END AS data_status
        FROM {stations} s
        LEFT JOIN {facts} f ON f.station_id = s.station_id
        LEFT JOIN (SELECT x.city_code, max(y.service_date) AS anchor FROM {stations} x
                   JOIN {facts} y ON y.station_id = x.station_id GROUP BY 1) c ON c.city_code = s.city_code
        GROUP BY s.station_id, s.city_code, s.name"""


def _score_cte(metrics: str) -> str:
    return f"""
        SELECT m.*, CASE WHEN data_status = 'missing' THEN -1 ELSE CAST(floor(100 - (
                 row_number() OVER w / CAST(count(*) OVER (PARTITION BY city_code, data_status) AS DOUBLE)) * 100) AS INTEGER)
               END AS score
        FROM {metrics} m
        WINDOW w AS (PARTITION BY city_code, data_status ORDER BY rolling_30d_avg, station_id)"""


CTES = {
    "suppliers": "SELECT s_suppkey AS station_id, n_name AS city_code, s_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "one_city": "SELECT s_suppkey AS station_id, 'all' AS city_code, s_name AS name FROM supplier",
    "facts": "SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS service_date, CAST(sum(l_quantity) AS BIGINT) AS entries"
             " FROM lineitem GROUP BY 1, 2",
    "customers": "SELECT c_custkey AS station_id, n_name AS city_code, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "visits": "SELECT user_id AS station_id, CAST(ts AS DATE) AS service_date, count(*) AS entries FROM events GROUP BY 1, 2",
    "metrics": _metrics_cte("suppliers", "facts"),
    "city_metrics": _metrics_cte("one_city", "facts"),
    "visit_metrics": _metrics_cte("customers", "visits"),
    "scored": _score_cte("metrics"),
    "city_scored": _score_cte("city_metrics"),
    "visit_scored": _score_cte("visit_metrics"),
    "parts": "SELECT p_partkey AS station_id, 'all' AS city_code, p_brand AS external_id,"
             " CASE WHEN p_size <= 5 THEN 'r' || p_partkey END AS ridership_id,"
             " CASE WHEN p_size > 40 THEN p_name ELSE p_name || ' (' || p_type || ')' END AS name,"
             " CASE WHEN p_size > 45 AND p_brand = 'Brand#1' THEN CAST([] AS VARCHAR[]) ELSE [p_type] END AS lines FROM part",
    "records": "SELECT CASE WHEN l_returnflag = 'R' OR l_linenumber IN (1, 6) THEN 'x' ELSE 'r' END || l_partkey AS ridership_id, CASE WHEN l_returnflag = 'R' THEN 'lost ' || p_name"
               " WHEN l_linenumber = 7 THEN p_name"
               f" ELSE p_name || '-' || ({text_array(SUFFIXES)})[CAST(l_linenumber % 5 + 1 AS INTEGER)] END AS stationname,"
               " strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000' AS date, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS rides"
               " FROM lineitem JOIN part ON p_partkey = l_partkey",
    "order_lines": "SELECT o_custkey AS station_id, list_sort(list(DISTINCT o_orderpriority)) AS lines FROM orders GROUP BY 1",
    "points": "SELECT event_type AS route_id, CAST(user_id AS VARCHAR) AS shape_id, event_id AS seq,"
              " CAST(-87.65 AS DOUBLE) + CAST(CAST(round(value * 100) AS BIGINT) % 10 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon,"
              " CAST(41.865 AS DOUBLE) + CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS DOUBLE) * CAST(0.001 AS DOUBLE)"
              " AS lat FROM events",
    "pairs": "SELECT * FROM (SELECT 'all' AS route_id, shape_id, seq, lon AS a_lon, lat AS a_lat, lead(seq) OVER w AS next_seq,"
             " lead(lon) OVER w AS b_lon, lead(lat) OVER w AS b_lat, route_id AS kind FROM points"
             " WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) WHERE next_seq IS NOT NULL",
}


def with_ctes(names: str, body: str) -> str:
    """The body with the named common table expressions before it, in the given order."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names.split()) + ("" if body.lstrip().startswith(",") else "\n") + body
