"""Tracks: shapes, shared segments, offsets, stitching, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics.functions import geo as G
from hubmetrics.functions.geo import line_distance
from hubmetrics.operators import simplify as S
from hubmetrics.operators import stitch as C
from hubmetrics.operators import tracks as T
from hubmetrics.queries.registry import query
from hubmetrics.queries.standins import (
    PRIORITIES, TYPES, order_lines, part_stations, shape_points, sql_haversine, table, text_array, user_points, with_ctes,
)
from hubmetrics.sources import features as E
from hubmetrics.sources import gtfs
from hubmetrics.sources.collections import write_collections
from hubmetrics.sources.features import write_report
from hubmetrics.storage import lookup_table, scratch_path

_ROUTES = {"click": "Red", "view": "Blue", "error": "Green", "purchase": "Pink"}
_ROUTE_NAMES = text_array(_ROUTES)[1:-1]
_LINE = "CASE route_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROUTES.items()) + " ELSE route_id END"


@query(with_ctes("points", f"""SELECT t.event_type AS route_id, p.shape_id, count(*) AS n, CAST(min(p.seq) AS BIGINT) AS first_seq,
    round(sum(p.lon), 6) AS lon_sum, round(sum(p.lat), 6) AS lat_sum FROM points p
    JOIN (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS shape_id FROM events WHERE event_type IN ({_ROUTE_NAMES})) t USING (shape_id)
    GROUP BY 1, 2"""))
def route_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes, trips and shapes written as GTFS files and read back."""
    events = table(spark, sf, "events")
    folder = scratch_path(spark, "gtfs")
    write_report(events.select(F.col("event_type").alias("route_id")).distinct(), f"{folder}/routes")
    write_report(events.select(F.col("event_type").alias("route_id"), F.col("user_id").alias("shape_id")), f"{folder}/trips")
    write_report(user_points(spark, sf).select(
        "shape_id", F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"), F.col("seq").alias("shape_pt_sequence")
    ), f"{folder}/shapes")
    shapes = T.route_shapes(
        gtfs.read_routes(spark, f"{folder}/routes", _ROUTES), gtfs.read_trips(spark, f"{folder}/trips"),
        gtfs.read_shapes(spark, f"{folder}/shapes"), _ROUTES,
    )
    return shapes.groupBy("route_id", "shape_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.round(F.sum("lon"), 6).alias("lon_sum"),
        F.round(F.sum("lat"), 6).alias("lat_sum"),
    )


@query(with_ctes("points pairs", f"""SELECT shape_id, seq, next_seq, a_lon, a_lat, b_lon, b_lat, round({sql_haversine('a_', 'b_')}, 4) AS metres,
    {sql_haversine('a_', 'b_')} > 1000 AS is_long FROM pairs"""))
def polyline_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_pairs(T.polyline_pairs(user_points(spark, sf)))


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "shape_id", "seq", "next_seq", F.col("p1.lon").alias("a_lon"), F.col("p1.lat").alias("a_lat"),
        F.col("p2.lon").alias("b_lon"), F.col("p2.lat").alias("b_lat"), F.round("metres", 4).alias("metres"), "is_long",
    )


def _bucket_sql(metres: str) -> str:
    return (f"CASE WHEN {metres} < 50 THEN '0-50m' WHEN {metres} < 200 THEN '50-200m' WHEN {metres} < 500 THEN '200-500m'"
            f" WHEN {metres} < 1000 THEN '500-1000m' ELSE '1000m+' END")


@query(with_ctes("points pairs", f"SELECT {_bucket_sql(sql_haversine('a_', 'b_'))} AS bucket, count(*) AS n_segments FROM pairs GROUP BY 1"))
def haversine_hist(spark: SparkSession, sf: str) -> DataFrame:
    return T.length_histogram(T.polyline_pairs(user_points(spark, sf)))


@query(with_ctes("points", "SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, 1 AS plausible FROM points"))
def bbox(spark: SparkSession, sf: str) -> DataFrame:
    return T.bounding_box(shape_points(spark, sf))


_KEYED = """, raw AS (SELECT * FROM (SELECT route_id, shape_id, seq, lon AS a_lon, lat AS a_lat, lead(lon) OVER w AS b_lon, lead(lat) OVER w AS b_lat
      FROM points WINDOW w AS (PARTITION BY route_id, shape_id ORDER BY seq)) WHERE b_lon IS NOT NULL),
    boxed AS (SELECT *, CASE WHEN a_lon BETWEEN CAST(-87.64 AS DOUBLE) AND CAST(-87.62 AS DOUBLE) AND a_lat BETWEEN CAST(41.87 AS DOUBLE) AND CAST(41.89 AS DOUBLE)
      AND b_lon BETWEEN CAST(-87.64 AS DOUBLE) AND CAST(-87.62 AS DOUBLE) AND b_lat BETWEEN CAST(41.87 AS DOUBLE) AND CAST(41.89 AS DOUBLE) THEN 4 ELSE 5 END AS digits FROM raw),
    snapped AS (SELECT *, round(a_lon, digits) AS x1, round(a_lat, digits) AS y1, round(b_lon, digits) AS x2, round(b_lat, digits) AS y2 FROM boxed),
    keyed AS (SELECT *, CASE WHEN (x1, y1) < (x2, y2) THEN printf('%.5f,%.5f_%.5f,%.5f', x1, y1, x2, y2)
      ELSE printf('%.5f,%.5f_%.5f,%.5f', x2, y2, x1, y1) END AS segment_key, (a_lon, a_lat) <= (b_lon, b_lat) AS forward FROM snapped)
    """
_SEGMENTS = _KEYED + f""", lines AS (SELECT segment_key, list_sort(list(DISTINCT {_LINE})) AS lines FROM keyed GROUP BY 1),
    lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_key ORDER BY route_id DESC, shape_id DESC, seq DESC) AS rn FROM keyed) WHERE rn = 1),
    segments AS (SELECT l.segment_key, l.lines, CASE
        WHEN len(list_intersect(l.lines, ['Brown', 'Green', 'Orange', 'Pink', 'Purple'])) >= 3 THEN 'Loop'
        WHEN list_has_all(l.lines, ['Brown', 'Purple']) THEN 'North Main' WHEN list_has_all(l.lines, ['Red', 'Green']) THEN 'South Side'
        WHEN l.lines = ['Blue', 'Pink'] THEN 'Forest Park' WHEN l.lines = ['Green', 'Pink'] THEN 'West Side'
        WHEN len(l.lines) > 1 THEN 'Shared' ELSE l.lines[1] END AS corridor,
      CASE WHEN forward THEN a_lon ELSE b_lon END AS p_lon, CASE WHEN forward THEN a_lat ELSE b_lat END AS p_lat,
      CASE WHEN forward THEN b_lon ELSE a_lon END AS q_lon, CASE WHEN forward THEN b_lat ELSE a_lat END AS q_lat
      FROM lines l JOIN lasts USING (segment_key))
    """


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return T.polyline_pairs(shape_points(spark, sf))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return T.shared_segments(_pairs(spark, sf), _ROUTES)


@query(with_ctes("points", _KEYED + "SELECT segment_key, count(*) AS n FROM keyed GROUP BY 1"))
def segment_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = G.segment_key(F.col("p1"), F.col("p2")).alias("segment_key")
    return _pairs(spark, sf).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


_FLAT = "array_to_string(lines, ',') AS lines, corridor, p_lon, p_lat, q_lon, q_lat"


def _flat(segments: DataFrame, *ids: str) -> DataFrame:
    return segments.select(
        *ids, F.array_join("lines", ",").alias("lines"), "corridor", F.col("p1.lon").alias("p_lon"), F.col("p1.lat").alias("p_lat"),
        F.col("p2.lon").alias("q_lon"), F.col("p2.lat").alias("q_lat"),
    )


@query(with_ctes("points", _SEGMENTS + f"SELECT segment_key, {_FLAT} FROM segments"))
def shared_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_segments(spark, sf), "segment_key")


@query(with_ctes("points", _SEGMENTS + "SELECT corridor, corridor = 'Loop' AS is_loop, count(*) AS n_segments FROM segments GROUP BY 1"))
def corridors(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).groupBy("corridor", "is_loop").agg(F.count(F.lit(1)).alias("n_segments"))


@query(with_ctes("points", _SEGMENTS + "SELECT CAST(len(lines) AS INTEGER) AS n_lines, count(*) AS n_segments FROM segments GROUP BY 1"))
def sharing_hist(spark: SparkSession, sf: str) -> DataFrame:
    return T.sharing_histogram(_segments(spark, sf))


@query(with_ctes("points", _SEGMENTS + """SELECT segment_key, array_to_string(lines, ',') AS lines FROM segments
    WHERE len(lines) > 1 ORDER BY segment_key LIMIT 5"""))
def sample_shared(spark: SparkSession, sf: str) -> DataFrame:
    sample = T.sample_segments(_segments(spark, sf), shared_only=True)
    return sample.select("segment_key", F.array_join("lines", ",").alias("lines"))


_NUMBERED = _SEGMENTS + f"""SELECT printf('seg_%04d', row_number() OVER (ORDER BY segment_key) - 1) AS segment_id, {_FLAT} FROM segments"""


@query(with_ctes("points", _NUMBERED))
def numbered_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(T.number_segments(_segments(spark, sf)), "segment_id")


@query(with_ctes("points", _NUMBERED))
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered segments written as GeoJSON features and read back."""
    path = scratch_path(spark, "features")
    E.write_features(E.segment_features(T.number_segments(_segments(spark, sf))), path)
    return _flat(E.read_segment_features(spark, path), "segment_id")


@query(with_ctes("points", _NUMBERED))
def collection_features(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered segments written as whole FeatureCollections and read back by ranges of bytes."""
    path = scratch_path(spark, "collections")
    write_collections(E.segment_features(T.number_segments(_segments(spark, sf))), path)
    return _flat(E.read_segment_features(spark, path, per_line=False), "segment_id")


@query(with_ctes("parts", """SELECT station_id, name, list_contains(lines, 'PROMO') AS active, 'Point' AS kind FROM parts"""))
def station_point_features(spark: SparkSession, sf: str) -> DataFrame:
    from hubmetrics.functions.lines import any_line_active

    stations = part_stations(spark, sf).withColumns({"longitude": F.lit(-87.6), "latitude": F.lit(41.8), "score": F.lit(1)})
    features = E.station_features(stations, any_line_active(F.col("lines"), ["PROMO"]))
    schema = "type string, properties struct<station_id: bigint, name: string, active: boolean>, geometry struct<type: string>"
    return features.select(F.from_json("value", schema).alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"))


@query(f"""WITH order_lines AS (SELECT o_custkey AS station_id, list(DISTINCT o_orderpriority) AS lines, count(*) > 12 AS is_loop FROM orders GROUP BY 1),
    shown AS (SELECT station_id, is_loop, list_filter({text_array(PRIORITIES[::-1][:4])}, lambda x: list_contains(lines, x)) AS lines FROM order_lines),
    exploded AS (SELECT station_id, is_loop, len(lines) AS shared_count, unnest(range(len(lines))) AS i, lines FROM shown)
    SELECT CAST(station_id AS VARCHAR) AS segment_id, lines[i + 1] AS line, CAST(shared_count AS INTEGER) AS shared_count, CAST(i AS INTEGER) AS shared_index,
      (i - (shared_count - 1) / 2.0) * CASE WHEN is_loop THEN CAST(2.0 AS DOUBLE) ELSE CAST(3.5 AS DOUBLE) END AS offset_px FROM exploded""")
def explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded_orders(spark, sf).select("segment_id", "line", "shared_count", "shared_index", "offset_px")


def _exploded_orders(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("station_id")).agg((F.count(F.lit(1)) > 12).alias("is_loop"))
    segments = order_lines(spark, sf).join(sizes, "station_id").select(
        F.col("station_id").cast("string").alias("segment_id"), F.lit("c").alias("corridor"), "is_loop", "lines"
    )
    return C.explode_lines(segments, PRIORITIES[1:], PRIORITIES[::-1])


@query(f"SELECT o_orderpriority AS line, count(DISTINCT o_custkey) AS n_features FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def features_per_line(spark: SparkSession, sf: str) -> DataFrame:
    return C.features_per_line(_exploded_orders(spark, sf))


@query(f"SELECT o_orderpriority AS line, count(DISTINCT o_custkey) AS n_features FROM orders WHERE o_orderpriority IN ('5-LOW') GROUP BY 1")
def lost_lines(spark: SparkSession, sf: str) -> DataFrame:
    exploded = _exploded_orders(spark, sf)
    return C.lost_lines(exploded, exploded.where("line <> '5-LOW'"))


def _user_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of each user's points as segments on the line of their event type, users being corridors of the loop."""
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type")
    segments = T.polyline_pairs(user_points(spark, sf)).join(kinds, "seq").select(
        F.concat(F.lit("s"), F.col("seq").cast("string")).alias("segment_id"),
        F.concat(F.lit("u"), F.col("shape_id")).alias("corridor"), F.lit(True).alias("is_loop"),
        F.array("event_type").alias("lines"), "p1", "p2",
    )
    return C.explode_lines(segments, TYPES, TYPES)


_PIECES = """, pieces AS (SELECT 's' || seq || chr(31) || kind AS piece, shape_id, kind, printf('%.6f,%.6f', a_lon, a_lat) AS v0, printf('%.6f,%.6f', b_lon, b_lat) AS v1,
        a_lon, a_lat, b_lon, b_lat FROM pairs),
    ends AS (SELECT piece, 0 AS side, shape_id, kind, v0 AS vertex FROM pieces UNION ALL SELECT piece, 1, shape_id, kind, v1 FROM pieces),
    placed AS (SELECT *, (row_number() OVER (PARTITION BY shape_id, kind, vertex ORDER BY piece, side) + 1) // 2 AS pair FROM ends),
    links AS (SELECT a.piece, a.side, b.piece AS next_piece, 1 - b.side AS next_side FROM placed a
      JOIN placed b ON a.shape_id = b.shape_id AND a.kind = b.kind AND a.vertex = b.vertex AND a.pair = b.pair AND (a.piece, a.side) <> (b.piece, b.side)),
    arcs AS (SELECT p.piece, s.side, l.next_piece, l.next_side FROM pieces p CROSS JOIN (VALUES (0), (1)) s(side)
      LEFT JOIN links l ON l.piece = p.piece AND l.side = s.side),
    heads AS (SELECT a.piece, a.side FROM arcs a ANTI JOIN links l ON l.piece = a.piece AND l.side = 1 - a.side),
    walk AS (SELECT piece AS head_piece, side AS head_side, piece, side, 1 AS position FROM heads
      UNION ALL SELECT w.head_piece, w.head_side, l.next_piece, l.next_side, w.position + 1 FROM walk w JOIN links l ON l.piece = w.piece AND l.side = w.side),
    ring_arcs AS (SELECT a.* FROM arcs a ANTI JOIN walk w ON w.piece = a.piece AND w.side = a.side),
    ring_walk AS (SELECT piece AS head_piece, side AS head_side, piece, side, 1 AS position FROM ring_arcs
      UNION ALL SELECT w.head_piece, w.head_side, l.next_piece, l.next_side, w.position + 1 FROM ring_walk w JOIN links l ON l.piece = w.piece AND l.side = w.side
        WHERE (l.next_piece, l.next_side) <> (w.head_piece, w.head_side)),
    measured AS (SELECT *, min(piece) OVER h AS path_id, count(*) OVER h AS path_size FROM walk WINDOW h AS (PARTITION BY head_piece, head_side)),
    ring_measured AS (SELECT *, min(piece) OVER h AS path_id, count(*) OVER h AS path_size FROM ring_walk WINDOW h AS (PARTITION BY head_piece, head_side)),
    chosen AS (SELECT DISTINCT head_piece, head_side FROM measured WHERE piece = path_id AND side = 1),
    ordered AS (SELECT m.piece, m.side, m.position, m.path_id, m.path_size FROM measured m JOIN chosen c ON c.head_piece = m.head_piece AND c.head_side = m.head_side
      UNION ALL SELECT piece, side, position, path_id, path_size FROM ring_measured WHERE head_piece = path_id AND head_side = 1)
    """
_RECURSIVE = with_ctes("points pairs", _PIECES).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_RECURSIVE + "SELECT replace(path_id, chr(31), '/') AS path, replace(piece, chr(31), '/') AS piece, position, path_size, side = 0 AS reversed FROM ordered")
def stitch(spark: SparkSession, sf: str) -> DataFrame:
    ordered = C.stitch_order(_user_segments(spark, sf))
    return ordered.select(
        F.translate("path_id", "\u001f", "/").alias("path"), F.concat_ws("/", "segment_id", "line").alias("piece"), "position",
        "path_size", "reversed",
    )


@query(_RECURSIVE + """, steps AS (SELECT o.*, CASE WHEN side = 1 THEN p.a_lon ELSE p.b_lon END AS lon, CASE WHEN side = 1 THEN p.v1 ELSE p.v0 END AS vertex FROM ordered o
      JOIN pieces p ON p.piece = o.piece)
    SELECT replace(path_id, chr(31), '/') AS path, CAST(max(path_size) AS BIGINT) AS segment_count, CAST(max(path_size) + 1 AS INTEGER) AS n_points,
      max(lon) FILTER (position = 1) AS first_lon, max(vertex) FILTER (position = path_size) AS last_vertex FROM steps GROUP BY 1""")
def stitched_features(spark: SparkSession, sf: str) -> DataFrame:
    features = C.stitch(_user_segments(spark, sf))
    return features.select(
        F.translate("path_id", "\u001f", "/").alias("path"), "segment_count", F.size("points").alias("n_points"),
        F.get("points", 0)["lon"].alias("first_lon"), G.vertex_key(F.element_at("points", -1)).alias("last_vertex"),
    )


@query(_RECURSIVE + """SELECT split_part(path_id, chr(31), 1) AS segment_id, CAST(max(path_size) AS BIGINT) AS segment_count,
    CAST(max(path_size) + 1 AS INTEGER) AS n_points FROM ordered GROUP BY path_id""")
def stitched_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Stitched paths as GeoJSON features, written and read back."""
    path = scratch_path(spark, "features")
    E.write_features(E.path_features(C.stitch(_user_segments(spark, sf))), path)
    schema = "properties struct<segment_id: string, segment_count: bigint>, geometry struct<coordinates: array<array<double>>>"
    return spark.read.schema(schema).json(path).select("properties.*", F.size("geometry.coordinates").alias("n_points"))


@query(_RECURSIVE + """SELECT segment_count, count(*) AS n_features FROM (SELECT path_id, CAST(max(path_size) AS BIGINT) AS segment_count FROM ordered GROUP BY 1) GROUP BY 1""")
def stitched_per_count(spark: SparkSession, sf: str) -> DataFrame:
    return C.features_per_count(C.path_sizes(C.stitch_order(_user_segments(spark, sf))))


@query(_RECURSIVE[:_RECURSIVE.index("placed AS")].rstrip().rstrip(",") + """,
    reach AS (SELECT piece, piece AS other FROM pieces UNION
      SELECT r.piece, b.piece FROM reach r JOIN ends a ON a.piece = r.other JOIN ends b ON b.shape_id = a.shape_id AND b.kind = a.kind AND b.vertex = a.vertex)
    SELECT replace(piece, chr(31), '/') AS piece, replace(min(other), chr(31), '/') AS component FROM reach GROUP BY 1""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    labels = C.components(_user_segments(spark, sf))
    return labels.select(F.translate("piece", "\u001f", "/").alias("piece"), F.translate("component", "\u001f", "/").alias("component"))


@query(_RECURSIVE + """SELECT p.kind AS line, count(*) AS n_before, count(DISTINCT o.path_id) AS n_after, false AS lost
    FROM pieces p JOIN ordered o ON o.piece = p.piece GROUP BY 1""")
def line_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Features of each line before and after they are really stitched."""
    exploded = _user_segments(spark, sf)
    return C.line_losses(exploded, C.stitch(exploded))


# Both ends of every segment are moved to one or the other side of a border of rounding, by less than the tolerance.
_NEAR = with_ctes("points pairs", """, ends AS (
      SELECT 's' || seq || '/' || kind AS piece, shape_id, kind, a_lon + CAST(5e-7 AS DOUBLE) + CAST(4e-7 AS DOUBLE) * (seq % 3 - 1) AS lon,
        a_lat + CAST(3e-7 AS DOUBLE) * (seq % 2) AS lat FROM pairs
      UNION ALL SELECT 's' || seq || '/' || kind, shape_id, kind, b_lon + CAST(5e-7 AS DOUBLE) - CAST(4e-7 AS DOUBLE) * (seq % 3 - 1), b_lat FROM pairs),
    near AS (SELECT DISTINCT a.piece, b.piece AS other FROM ends a JOIN ends b ON a.shape_id = b.shape_id AND a.kind = b.kind
      AND abs(a.lon - b.lon) < 1e-6 AND abs(a.lat - b.lat) < 1e-6),
    reach AS (SELECT piece, piece AS other FROM ends UNION SELECT r.piece, n.other FROM reach r JOIN near n ON n.piece = r.other),
    labels AS (SELECT piece, min(other) AS component FROM reach GROUP BY 1)
    """).replace("WITH ", "WITH RECURSIVE ", 1)


def _moved_segments(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.substring("segment_id", 2, 20).cast("bigint")
    aside = F.lit(4e-7) * (seq % 3 - 1)
    return _user_segments(spark, sf).withColumns({
        "p1": G.point(F.col("p1.lon") + F.lit(5e-7) + aside, F.col("p1.lat") + F.lit(3e-7) * (seq % 2)),
        "p2": G.point(F.col("p2.lon") + F.lit(5e-7) - aside, F.col("p2.lat")),
    })


@query(_NEAR + "SELECT * FROM labels")
def components_of_near_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Components of segments whose ends meet within the tolerance only."""
    labels = C.components(_moved_segments(spark, sf))
    return labels.select(F.translate("piece", "\u001f", "/").alias("piece"), F.translate("component", "\u001f", "/").alias("component"))


@query(_NEAR + "SELECT component, count(*) AS n_segments FROM labels GROUP BY 1")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = C.component_sizes(C.components(_moved_segments(spark, sf)))
    return sizes.select(F.translate("component", "\u001f", "/").alias("component"), "n_segments")


_SIMPLIFY = with_ctes("points", """, pts AS (SELECT shape_id, seq, lon, lat, row_number() OVER (PARTITION BY shape_id ORDER BY seq) AS rn FROM points),
    spans AS (SELECT shape_id, CAST(1 AS BIGINT) AS a, count(*) AS b FROM pts GROUP BY 1 HAVING count(*) > 1
      UNION ALL
      SELECT shape_id, unnest([a, -far.m]), unnest([-far.m, b]) FROM (
        SELECT s.shape_id, s.a, s.b, max({'d': CASE WHEN x.lon = y.lon AND x.lat = y.lat
            THEN sqrt((p.lon - x.lon) * (p.lon - x.lon) + (p.lat - x.lat) * (p.lat - x.lat))
            ELSE abs((y.lat - x.lat) * p.lon - (y.lon - x.lon) * p.lat + y.lon * x.lat - y.lat * x.lon)
              / sqrt((y.lat - x.lat) * (y.lat - x.lat) + (y.lon - x.lon) * (y.lon - x.lon)) END, 'm': -p.rn}) AS far
        FROM spans s JOIN pts x ON x.shape_id = s.shape_id AND x.rn = s.a JOIN pts y ON y.shape_id = s.shape_id AND y.rn = s.b
        JOIN pts p ON p.shape_id = s.shape_id AND p.rn > s.a AND p.rn < s.b GROUP BY 1, 2, 3) WHERE far.d > TOLERANCE),
    kept AS (SELECT DISTINCT shape_id, unnest([a, b]) AS rn FROM spans)
    SELECT k.shape_id, p.seq, p.lon, p.lat FROM kept k JOIN pts p USING (shape_id, rn)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_SIMPLIFY.replace("TOLERANCE", "CAST(0.002 AS DOUBLE)"))
def simplify(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.simplified_pairs(user_points(spark, sf), tolerance=0.002)
    return S.simplified_points(pairs).select("shape_id", "seq", "lon", "lat")


@query(_SIMPLIFY.replace("TOLERANCE", "CAST(0.002 AS DOUBLE)"))
def simplify_large_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The same with slices so short that most shapes have several."""
    pairs = S.simplified_pairs(user_points(spark, sf), tolerance=0.002, slice_points=20)
    return S.simplified_points(pairs).select("shape_id", "seq", "lon", "lat")


@query(with_ctes("points", """, ends AS (SELECT shape_id, count(*) AS n_points, min_by({'lon': lon, 'lat': lat}, seq) AS a,
    max_by({'lon': lon, 'lat': lat}, seq) AS b FROM points GROUP BY 1)
    SELECT shape_id, n_points, round(max(CASE WHEN a.lon = b.lon AND a.lat = b.lat
        THEN sqrt((lon - a.lon) * (lon - a.lon) + (lat - a.lat) * (lat - a.lat))
        ELSE abs((b.lat - a.lat) * lon - (b.lon - a.lon) * lat + b.lon * a.lat - b.lat * a.lon)
          / sqrt((b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon)) END), 6) AS farthest
    FROM points JOIN ends USING (shape_id) GROUP BY 1, 2"""))
def farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    """How far each shape strays from the line between its ends."""
    points = user_points(spark, sf)
    place = F.struct("lon", "lat")
    ends = points.groupBy("shape_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(place, "seq").alias("a"), F.max_by(place, "seq").alias("b"))
    return points.join(lookup_table(ends, "ends"), "shape_id").groupBy("shape_id", "n_points").agg(
        F.round(F.max(G.line_distance(place, F.col("a"), F.col("b"))), 6).alias("farthest"))


@query(with_ctes("points", f"SELECT {_LINE} AS line, count(*) AS n FROM points GROUP BY 1"))
def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shape_points(spark, sf).groupBy(T.code_line(F.col("route_id"), _ROUTES).alias("line")).agg(F.count(F.lit(1)).alias("n"))
