"""Folders of partitioned tables: drop, rename and compact them without touching what readers need."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType


def read_if_there(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet table with this schema; without rows if the folder does not exist yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    store, place = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def drop(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    store, place = _store(spark, path)
    if not store.rename(place, _store(spark, to)[1]):
        raise OSError(f"{path} cannot be renamed to {to}")


def _value(folder: str) -> str:
    """The value in the name of a partition's folder; a missing one is empty."""
    value = unquote(folder.partition("=")[2])
    return "" if value == "__HIVE_DEFAULT_PARTITION__" else value


def drop_partitions(spark: SparkSession, path: str, wanted: Iterable[tuple[str | None, str]]) -> None:
    """Delete the folders of some pairs of values of a table's two partition columns. Nothing is read."""
    inner: dict[str, set[str]] = {}
    for a, b in wanted:
        inner.setdefault(a or "", set()).add(b)
    for outer in names(spark, path) if inner else []:
        if "=" in outer and _value(outer) in inner:
            for name in names(spark, f"{path}/{outer}"):
                if _value(name) in inner[_value(outer)]:
                    drop(spark, f"{path}/{outer}/{name}")


def compact(spark: SparkSession, path: str, schema: StructType, before: int, most: int) -> None:
    """Merge the folders ``batch=N`` with N below ``before`` into the last of them once there are more than ``most``.

    The merged rows are complete in a hidden folder before the first source goes, and a run that was interrupted after that is
    finished by the next one, so no row is lost or doubled.
    """
    for name in names(spark, path):
        if found := re.fullmatch(r"_merged-(-?\d+)", name):
            _replace(spark, path, int(found[1]))
    batches = [b for b in _batches(spark, path) if b < before]
    if len(batches) > most:
        last = max(batches)
        rows = spark.read.schema(schema).parquet(*[f"{path}/batch={b}" for b in batches])
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}/_merged-{last}")
        _replace(spark, path, last)


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removeprefix("batch=")) for n in names(spark, path) if re.fullmatch(r"batch=-?\d+", n)]


def _replace(spark: SparkSession, path: str, last: int) -> None:
    merged = f"{path}/_merged-{last}"
    if not exists(spark, f"{merged}/_SUCCESS"):
        drop(spark, merged)
        return
    for b in _batches(spark, path):
        if b <= last:
            drop(spark, f"{path}/batch={b}")
    rename(spark, merged, f"{path}/batch={last}")


def batch_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches with their number, ``batch``."""
    return read_if_there(spark, path, StructType([*schema.fields, StructField("batch", LongType())]))
