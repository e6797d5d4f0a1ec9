"""Names, parsing and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.functions import lines as L
from hubmetrics.functions import names as N
from hubmetrics.functions import parse as P
from hubmetrics.operators import maintain as U
from hubmetrics.operators import match as X
from hubmetrics.operators import quality as Q
from hubmetrics.queries.registry import query
from hubmetrics.queries.standins import (
    HINTS, SPECIAL, part_records, part_stations, sql_base, sql_infer, sql_norm, sql_strip_paren, sql_suffix, table, text_array, with_ctes,
)
from hubmetrics.sources.features import unmatched_csv, write_report
from hubmetrics.sources.ridership import parse_csv_rows, parse_json_rows
from hubmetrics.storage import scratch_path


def _all_names(spark: SparkSession, sf: str) -> DataFrame:
    sources = [("supplier", "s_name"), ("part", "p_name"), ("nation", "n_name"), ("pages", "url"), ("orders", "o_orderpriority"),
               ("documents", "source")]
    every = None
    for name, column in sources:
        part = table(spark, sf, name).select(F.col(column).alias("name"))
        every = part if every is None else every.unionByName(part)
    return every


_NAMES_SQL = """WITH names AS (SELECT s_name AS name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation
    UNION ALL SELECT url FROM pages UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT source FROM documents)
    """


def _quoted(texts) -> list[str]:
    """Texts as they stand between quotes in SQL."""
    return [t.replace("'", "''") for t in texts]


_HINT_ROWS = dict(zip(_quoted(rules.LINE_HINTS), rules.LINE_HINTS.values()))
_HINTED = f"listed AS (SELECT station_id, name || '-' || {text_array(_HINT_ROWS)}[1 + station_id % {len(_HINT_ROWS)}] AS listed FROM parts)"


@query(with_ctes("parts", f""", {_HINTED}
    SELECT station_id, listed, {sql_infer('(' + sql_suffix('listed') + ')', _HINT_ROWS)} AS line FROM listed"""))
def feed_line_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that the feed's own suffixes point to, for names that end in each of them."""
    suffixes = L.string_array(rules.LINE_HINTS)
    place = (F.col("station_id") % len(rules.LINE_HINTS) + 1).cast("int")
    listed = part_stations(spark, sf).select("station_id", F.concat("name", F.lit("-"), F.element_at(suffixes, place)).alias("listed"))
    return listed.withColumn("line", N.infer_line(N.split_name(F.col("listed"))["suffix"], rules.LINE_HINTS))


@query(with_ctes("parts", f""", coded AS (SELECT *, {text_array([*rules.ROUTE_LINES, 'X'])}[1 + station_id % {len(rules.ROUTE_LINES) + 1}] AS route_id FROM parts),
    routes(route_id, line) AS (VALUES {", ".join(f"('{c}', '{n}')" for c, n in rules.ROUTE_LINES.items())})
    SELECT route_id, line, count(*) AS n FROM coded LEFT JOIN routes USING (route_id) GROUP BY 1, 2"""))
def feed_route_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the feed's route codes; an unknown code has none."""
    codes = L.string_array([*rules.ROUTE_LINES, "X"])
    coded = part_stations(spark, sf).withColumn("route_id", F.element_at(codes, (F.col("station_id") % (len(rules.ROUTE_LINES) + 1) + 1).cast("int")))
    line = F.try_element_at(N.literal_map(rules.ROUTE_LINES), F.col("route_id"))
    return coded.groupBy("route_id", line.alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes("parts", r"""SELECT station_id, coalesce(list_contains(list_transform(lines, lambda x: lower(x)),
      lower(regexp_extract(name, '\(([^)]*)\)', 1))), false) AS named FROM parts"""))
def contains_line(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a station has the line that its name gives, here written in capitals."""
    line = F.upper(F.regexp_extract("name", r"\(([^)]*)\)", 1))
    return part_stations(spark, sf).select("station_id", L.contains_line(F.col("lines"), line).alias("named"))


@query(_NAMES_SQL + f"SELECT name, {sql_norm('name')} AS normalized, count(*) AS n FROM names GROUP BY 1, 2")
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    names = _all_names(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("normalized", N.normalize_name(F.col("name")))


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS digest FROM documents")
def normalize_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(N.normalize_name(F.col("text"))).alias("digest"))


@query(_NAMES_SQL + f"SELECT DISTINCT name, {sql_base('name')} AS base, {sql_suffix('name')} AS suffix FROM names")
def split_names(spark: SparkSession, sf: str) -> DataFrame:
    names = _all_names(spark, sf).distinct()
    return names.select("name", N.split_name(F.col("name"))["base"].alias("base"), N.split_name(F.col("name"))["suffix"].alias("suffix"))


@query(f"""SELECT o_orderpriority AS name, {sql_infer(sql_suffix('o_orderpriority'))} AS line, count(*) AS n
    FROM orders GROUP BY 1, 2""")
def infer_line(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("line", N.infer_line(N.split_name(F.col("name"))["suffix"], HINTS))


@query(with_ctes("parts", f"SELECT station_id, {sql_strip_paren('name')} AS base FROM parts"))
def strip_paren(spark: SparkSession, sf: str) -> DataFrame:
    return part_stations(spark, sf).select("station_id", N.strip_paren(F.col("name")).alias("base"))


@query(with_ctes("parts", """
    SELECT station_id, sha256('all|' || station_id) AS key FROM parts"""))
def surrogate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return part_stations(spark, sf).select(
        "station_id", N.surrogate_key(F.col("city_code"), F.col("station_id").cast("string")).alias("key")
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS service_date,
           CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey END AS entries,
           o_orderkey % 4 <> 3 AND o_orderkey % 3 <> 1 AS is_valid
    FROM orders""")
def parse_dates_ints(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates and numbers rendered to text in the feed's formats, also broken ones, and read back."""
    orders = table(spark, sf, "orders")
    kind, digits = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    date = (
        F.when(kind == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yy"))
    )
    rides = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), digits, F.lit(" ")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(digits, F.lit(".0"))).otherwise(F.concat(F.lit("+"), digits))
    )
    rows = orders.select("o_orderkey", F.lit("x").alias("stationname"), date.alias("service_date"), rides.alias("rides"))
    typed = rows.select(
        "o_orderkey", P.parse_service_date(F.col("service_date")).alias("d"), P.parse_count(F.col("rides")).alias("entries")
    )
    return typed.select(
        "o_orderkey", P.day_text(F.col("d")).alias("service_date"), "entries",
        (F.col("d").isNotNull() & F.col("entries").isNotNull()).alias("is_valid"),
    )


@query("""
    SELECT count(*) FILTER (o_orderkey % 4 <> 3 AND o_orderkey % 3 <> 1) AS accepted,
           count(*) FILTER (o_orderkey % 4 = 3 OR o_orderkey % 3 = 1) AS rejected FROM orders""")
def csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.col("o_custkey").cast("string")
    rows = table(spark, sf, "orders").select(
        F.lit("x").alias("stationname"),
        F.when(F.col("o_orderkey") % 4 == 3, "13/45/2024").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("service_date"),
        F.when(F.col("o_orderkey") % 3 == 1, F.concat(digits, F.lit("x"))).otherwise(digits).alias("rides"),
    )
    valid = F.col("is_valid")
    return parse_csv_rows(rows).agg(F.count_if(valid).alias("accepted"), F.count_if(~valid).alias("rejected"))


@query(with_ctes("records", """
    SELECT CAST(substr(date, 1, 10) AS VARCHAR) AS service_date, count(*) AS n,
           CAST(sum(CASE WHEN stationname LIKE 'lost%' THEN 0 ELSE CAST(rides AS BIGINT) END) AS BIGINT) AS entries
    FROM records GROUP BY 1"""))
def parse_json_feed(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("stationname").startswith("lost"), F.concat("rides", F.lit("?"))).otherwise(F.col("rides"))
    records = part_records(spark, sf).withColumnRenamed("ridership_id", "station_id").withColumn("rides", broken)
    days = parse_json_rows(records).where("is_valid").groupBy(P.day_text(F.col("service_date")).alias("service_date"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"))


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    return X.station_aliases(part_stations(spark, sf))


_ALIAS_CTE = with_ctes(
    "parts records", f""", aliases AS (SELECT station_id, name AS alias_name, {sql_norm('name')} AS normalized FROM parts),
    alias_index AS (SELECT normalized, min(station_id) AS station_id, count(DISTINCT station_id) AS n_stations FROM aliases GROUP BY 1)
    """)


@query(_ALIAS_CTE + f"""SELECT r.stationname, i.station_id, count(*) AS n FROM records r
    LEFT JOIN alias_index i ON i.normalized = {sql_norm('r.stationname')} GROUP BY 1, 2""")
def alias_match(spark: SparkSession, sf: str) -> DataFrame:
    matched = X.match_by_alias(part_records(spark, sf), _aliases(spark, sf))
    return matched.groupBy("stationname", "station_id").agg(F.count(F.lit(1)).alias("n"))


@query(_ALIAS_CTE + f"""SELECT stationname, count(*) AS occurrences FROM records r
    WHERE NOT EXISTS (SELECT 1 FROM aliases a WHERE a.normalized = {sql_norm('r.stationname')}) GROUP BY 1""")
def alias_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Written as a report and read back."""
    report = Q.unmatched_names(X.unmatched_by_alias(part_records(spark, sf), _aliases(spark, sf)))
    path = scratch_path(spark, "unmatched")
    write_report(report, path)
    return spark.read.schema("stationname string, occurrences bigint").csv(path, header=True)


@query(_ALIAS_CTE + "SELECT normalized, station_id, n_stations FROM alias_index WHERE n_stations > 1")
def ambiguous_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return X.ambiguous_aliases(_aliases(spark, sf))


@query(with_ctes("parts records", f""", aliases AS (
      SELECT station_id, 'lost ' || name AS alias_name, {sql_norm("'lost ' || name")} AS normalized FROM parts),
    by_alias AS (SELECT normalized, min(station_id) AS station_id FROM aliases GROUP BY 1),
    by_name AS (SELECT {sql_norm('name')} AS normalized, min(station_id) AS station_id FROM parts GROUP BY 1)
    SELECT n.stationname, coalesce(a.station_id, b.station_id) AS station_id
    FROM (SELECT DISTINCT stationname FROM records) n
    LEFT JOIN by_alias a ON a.normalized = {sql_norm('n.stationname')} LEFT JOIN by_name b ON b.normalized = {sql_norm('n.stationname')}"""))
def alias_or_name_match(spark: SparkSession, sf: str) -> DataFrame:
    stations = part_stations(spark, sf)
    lost = X.station_aliases(stations.withColumn("name", F.concat(F.lit("lost "), "name")))
    names = part_records(spark, sf).select("stationname").distinct()
    return X.match_by_alias_or_name(names, lost, stations)


@query(_ALIAS_CTE + """, listed AS (SELECT * FROM (VALUES ('red bolt', '1'), ('blue gear', '2'), ('no such place', '3')) v(stationname, id))
    SELECT l.stationname, l.id, a.alias_name, p.station_id, p.name AS station_name FROM listed l
    LEFT JOIN aliases a ON a.alias_name = l.stationname LEFT JOIN parts p ON p.station_id = a.station_id""")
def alias_exact(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.sql(
        "SELECT * FROM VALUES ('red bolt', '1'), ('blue gear', '2') AS v(stationname, id) UNION ALL SELECT 'no such place', '3'"
    )
    return X.match_exact_alias(listed, _aliases(spark, sf), part_stations(spark, sf))


@query(_ALIAS_CTE + """, listed AS (SELECT alias_name AS stationname FROM aliases)
    SELECT l.stationname, a.alias_name, p.station_id, p.name AS station_name FROM listed l
    LEFT JOIN (SELECT DISTINCT alias_name, station_id FROM aliases) a ON a.alias_name = l.stationname
    LEFT JOIN parts p ON p.station_id = a.station_id""")
def alias_exact_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Every alias looked up in a table that lists each of them three times."""
    aliases = _aliases(spark, sf)
    thrice = aliases.unionByName(aliases).unionByName(aliases)
    return X.match_exact_alias(aliases.select(F.col("alias_name").alias("stationname")), thrice, part_stations(spark, sf))


_SPECIAL_ROWS = ", ".join(f"('{raw}', '{target}')" for raw, targets in SPECIAL.items() for target in targets)
_MATCH_CTE = with_ctes("parts records", f""", special AS (SELECT raw, {sql_norm('target')} AS normalized FROM (VALUES {_SPECIAL_ROWS}) v(raw, target)),
    stations AS (SELECT *, {sql_norm('name')} AS normalized, {sql_norm(sql_strip_paren('name'))} AS base FROM parts),
    names AS (SELECT *, {sql_norm('stationname')} AS normalized, {sql_norm(sql_base('stationname'))} AS base,
                     {sql_infer(sql_suffix('stationname'))} AS line FROM (SELECT DISTINCT stationname FROM records)),
    candidates AS (
      SELECT n.stationname, s.station_id, CASE WHEN list_contains(list_transform(s.lines, lambda x: lower(x)), lower(n.line)) THEN 3
               WHEN len(s.lines) = 0 THEN 2 WHEN n.line = '' THEN 1 ELSE 0 END AS match_score
      FROM names n JOIN stations s ON s.base = n.base
      UNION ALL SELECT n.stationname, s.station_id, 4 FROM names n JOIN stations s ON s.normalized = n.normalized
      UNION ALL SELECT n.stationname, s.station_id, 4 FROM names n JOIN special p ON p.raw = n.stationname
        JOIN stations s ON s.normalized = p.normalized),
    best AS (SELECT stationname, max(match_score) AS match_score FROM candidates WHERE match_score > 0 GROUP BY 1),
    named AS (SELECT c.stationname, c.match_score, min(c.station_id) AS station_id FROM candidates c
              JOIN best b ON b.stationname = c.stationname AND b.match_score = c.match_score GROUP BY 1, 2),
    known AS (SELECT ridership_id, min(station_id) AS station_id FROM parts WHERE ridership_id IS NOT NULL GROUP BY 1),
    first_pass AS (SELECT r.ridership_id, r.stationname, coalesce(k.station_id, n.station_id) AS station_id
                   FROM (SELECT DISTINCT ridership_id, stationname FROM records) r LEFT JOIN known k USING (ridership_id)
                   LEFT JOIN named n ON n.stationname = r.stationname),
    resolved AS (SELECT ridership_id, stationname, coalesce(station_id, min(station_id) OVER (PARTITION BY ridership_id)) AS station_id
                 FROM first_pass)
    """)


@query(_MATCH_CTE + """SELECT n.stationname, n.base, n.line, m.station_id, coalesce(m.match_score, 0) AS match_score
    FROM names n LEFT JOIN named m ON m.stationname = n.stationname""")
def scored_match(spark: SparkSession, sf: str) -> DataFrame:
    scored = X.scored_names(part_records(spark, sf), part_stations(spark, sf), HINTS, SPECIAL)
    return scored.select("stationname", "base", "line", "station_id", "match_score")


@query(_MATCH_CTE + "SELECT * FROM resolved")
def scored_match_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    return X.resolve_pairs(part_records(spark, sf), part_stations(spark, sf), HINTS, SPECIAL)


@query(_MATCH_CTE + """SELECT r.ridership_id, k.station_id, count(*) AS n FROM records r LEFT JOIN known k ON k.ridership_id = r.ridership_id
    GROUP BY 1, 2""")
def id_match(spark: SparkSession, sf: str) -> DataFrame:
    matched = X.match_by_id(part_records(spark, sf), part_stations(spark, sf))
    return matched.groupBy("ridership_id", "station_id").agg(F.count(F.lit(1)).alias("n"))


@query(_MATCH_CTE + """SELECT p.station_id, coalesce(l.ridership_id, p.ridership_id) AS ridership_id FROM parts p LEFT JOIN (
      SELECT station_id, min(ridership_id) AS ridership_id FROM resolved WHERE station_id IS NOT NULL
        AND station_id IN (SELECT station_id FROM parts WHERE ridership_id IS NULL) GROUP BY 1) l ON l.station_id = p.station_id""")
def learned_ids(spark: SparkSession, sf: str) -> DataFrame:
    stations = part_stations(spark, sf)
    learned = X.learned_ids(part_records(spark, sf), stations, HINTS, SPECIAL)
    return U.store_learned_ids(stations, learned).select("station_id", "ridership_id")


_REPORT_SQL = """, unmatched AS (SELECT r.* FROM records r JOIN resolved x ON x.ridership_id = r.ridership_id AND x.stationname = r.stationname
      WHERE x.station_id IS NULL),
    seen AS (SELECT base, arg_min(name, station_id) AS name, arg_min(lines, station_id) AS lines FROM stations GROUP BY 1),
    report AS (
      SELECT u.ridership_id, u.stationname, n.normalized, count(*) AS occurrences, min(u.date) AS sample_date, min(u.date || '|' || u.rides) AS first_row,
             CASE WHEN s.base IS NOT NULL AND n.line <> '' THEN 'Base name matches ''' || s.name || ''' but line mismatch (expected: '
               || n.line || ', found: [' || array_to_string(s.lines, ' ') || '])' ELSE 'No station found with matching base name' END AS reason
      FROM unmatched u JOIN names n ON n.stationname = u.stationname LEFT JOIN seen s ON s.base = n.base
      GROUP BY ALL)
    """


@query(_MATCH_CTE + _REPORT_SQL + """SELECT ridership_id, stationname, normalized, reason, occurrences, sample_date,
    split_part(first_row, '|', 2) AS sample_rides FROM report""")
def unmatched_reasons(spark: SparkSession, sf: str) -> DataFrame:
    stations = part_stations(spark, sf)
    matched = X.match_by_score(part_records(spark, sf), stations, HINTS, SPECIAL)
    return Q.unmatched_report(matched.where(F.col("station_id").isNull()).drop("station_id"), stations, HINTS)


@query(_MATCH_CTE + _REPORT_SQL + "SELECT ridership_id AS station_id, stationname, normalized, reason, occurrences FROM report")
def unmatched_csv_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report written as CSV and read back."""
    path = scratch_path(spark, "unmatched-csv")
    write_report(unmatched_csv(unmatched_reasons(spark, sf)), path)
    schema = "station_id string, stationname string, normalized string, reason string, occurrences bigint"
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


@query(_MATCH_CTE + """, matched AS (SELECT r.ridership_id, x.station_id FROM records r
      JOIN resolved x ON x.ridership_id = r.ridership_id AND x.stationname = r.stationname)
    SELECT count(*) AS fetched, count(station_id) AS inserted, count(*) - count(station_id) AS skipped,
           count(DISTINCT ridership_id) AS ids, count(DISTINCT ridership_id) FILTER (station_id IS NOT NULL) AS matched_ids,
           count(DISTINCT station_id) AS matched_stations,
           CAST(count(DISTINCT station_id) AS DOUBLE) / count(DISTINCT ridership_id) FILTER (station_id IS NOT NULL) * 100 AS match_rate,
           CAST(count(DISTINCT ridership_id) FILTER (station_id IS NOT NULL) AS DOUBLE) / count(DISTINCT ridership_id) * 100 AS true_match_rate
    FROM matched""")
def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    pairs = X.pair_counts(part_records(spark, sf))
    return Q.match_summary(X.match_by_score(pairs, part_stations(spark, sf), HINTS, SPECIAL), rows="n")


@query(with_ctes("parts", f""", wanted AS (SELECT DISTINCT p_name || ' stop' AS alias_name, p_name AS canonical FROM part
      UNION SELECT DISTINCT 'old ' || p_type, p_type FROM part),
    stations AS (SELECT station_id, {sql_norm('name')} AS full_name FROM parts),
    ranked AS (SELECT w.alias_name, w.canonical, s.station_id, row_number() OVER (PARTITION BY w.alias_name, w.canonical
                 ORDER BY length(s.full_name), s.full_name, s.station_id) AS rn
               FROM wanted w LEFT JOIN stations s ON s.full_name = {sql_norm('w.canonical')}
                 OR starts_with(s.full_name, {sql_norm('w.canonical')} || ' '))
    SELECT alias_name, canonical, station_id, {sql_norm('alias_name')} AS normalized FROM ranked WHERE rn = 1"""))
def prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    named = part.select(F.concat("p_name", F.lit(" stop")).alias("alias_name"), F.col("p_name").alias("canonical"))
    typed = part.select(F.concat(F.lit("old "), "p_type").alias("alias_name"), F.col("p_type").alias("canonical"))
    return X.match_by_prefix(named.unionByName(typed).distinct(), part_stations(spark, sf))


_RULES = [("Ring of Red", "red ring"), ("Ring of Red", "cold ring"), ("Bolt-Station", "blue bolt (PROMO)"), ("nothing", "no such name")]


@query(with_ctes("parts", f""", rules AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _RULES)}) v(alias_name, name)),
    old AS (SELECT station_id, name AS alias_name, {sql_norm('name')} AS normalized FROM parts)
    SELECT station_id, alias_name, normalized FROM old UNION
    SELECT p.station_id, r.alias_name, {sql_norm('r.alias_name')} FROM parts p JOIN rules r ON r.name = p.name"""))
def alias_rules(spark: SparkSession, sf: str) -> DataFrame:
    stations = part_stations(spark, sf)
    return U.insert_absent(X.station_aliases(stations), X.aliases_by_rule(_RULES, stations), ["station_id", "alias_name"])


@query(with_ctes("parts", """SELECT count(*) AS total_aliases, count(DISTINCT station_id) AS stations_with_aliases FROM (
    SELECT station_id, name FROM parts UNION ALL SELECT station_id, 'x' FROM parts WHERE ridership_id IS NOT NULL)"""))
def alias_coverage(spark: SparkSession, sf: str) -> DataFrame:
    stations = part_stations(spark, sf)
    known = stations.where(F.col("ridership_id").isNotNull()).withColumn("name", F.lit("x"))
    return Q.alias_coverage(X.station_aliases(stations).unionByName(X.station_aliases(known)))
