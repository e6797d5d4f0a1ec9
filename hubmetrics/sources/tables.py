"""The tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, root: str, name: str, city_code: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """A parquet table; the city predicate reaches the scan. With a schema, the codes in folder names keep its types."""
    table = (spark.read if schema is None else spark.read.schema(schema)).parquet(f"{root}/{name}")
    return table if city_code is None else table.where(F.col("city_code") == city_code)


def with_month(facts: DataFrame) -> DataFrame:
    return facts.withColumn("month", F.date_format("service_date", "yyyy-MM"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the metrics of the cities that ``metrics`` holds, those of other cities stay.

    Files are sorted by station and carry bloom filters of the ids, so that a lookup of one station reads one row group.
    """
    balanced = metrics.hint("rebalance", F.col("city_code")).sortWithinPartitions("city_code", "station_id")
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "parquet.bloom.filter.enabled#station_id", "true").partitionBy("city_code").parquet(path)


def write_months(facts: DataFrame, path: str) -> None:
    """Replace the months that ``facts`` holds; large months are split over several files."""
    balanced = with_month(facts).hint("rebalance", F.col("month"))
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
