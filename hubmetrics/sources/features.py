"""GeoJSON features in and out, report files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics import schemas
from hubmetrics.functions.geo import point
from hubmetrics.sources.collections import read_collections


def read_segment_features(spark: SparkSession, path: str, per_line: bool = True) -> DataFrame:
    """Segments from GeoJSON: one feature per line, or FeatureCollection files, each read by as many tasks as it needs.

    Features that cannot be read give NULLs.
    """
    if per_line:
        features = spark.read.schema(schemas.FEATURE).json(path)
    else:
        features = read_collections(spark, path).select(F.from_json("value", schemas.FEATURE).alias("f")).select("f.*")
    ends = F.col("geometry.coordinates")
    return features.select("properties.*", _as_point(F.get(ends, 0)).alias("p1"), _as_point(F.element_at(ends, -1)).alias("p2"))


def _as_point(pair: Column) -> Column:
    return point(F.get(pair, 0), F.get(pair, 1))


def _coordinates(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def segment_features(segments: DataFrame) -> DataFrame:
    """One LineString feature per segment, as text in the column ``value``."""
    properties = F.struct("segment_id", "corridor", "is_loop", "lines")
    line = F.array(_coordinates(F.col("p1")), _coordinates(F.col("p2")))
    return segments.select(_feature("LineString", line, properties).alias("value"))


def path_features(stitched: DataFrame) -> DataFrame:
    """One LineString feature per stitched path."""
    properties = F.struct(*[
        "segment_id", "corridor", "is_loop", "line", "shared_count", "shared_index", "offset_px", "segment_count",
    ])
    return stitched.select(_feature("LineString", F.transform("points", _coordinates), properties).alias("value"))


def station_features(stations: DataFrame, active: Column) -> DataFrame:
    """One Point feature per station, flagged as active or not."""
    properties = F.struct("station_id", "name", "lines", "score", active.alias("active"))
    return stations.select(_feature("Point", F.array("longitude", "latitude"), properties).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    features.write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV files with header."""
    report.write.csv(path, header=True, quote='"', escape='"')


def unmatched_csv(report: DataFrame) -> DataFrame:
    """The columns of the unmatched-name file."""
    return report.select(F.col("ridership_id").alias("station_id"), "stationname", "normalized", "reason", "occurrences")
