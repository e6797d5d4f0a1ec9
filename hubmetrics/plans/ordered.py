"""Exact positions and neighbours within ordered groups, without ever sorting a whole group in one task.

A plain window puts each group into one task, which fails once a single group holds a large share of the rows. Here the
rows are range-partitioned on (group, order), so a large group spreads over many slices; the window works per slice, and
what lies before or after a slice comes from a table with at most one row per slice that a group shares. That table is
bounded by the number of partitions, not by the data, so broadcasting it is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubmetrics.storage import materialize

_SLICE = "_slice"


def _keep_left(left: DataFrame, right: DataFrame, names: Sequence[str], added: Sequence[str], how: str) -> DataFrame:
    """Join on equal (or both NULL) names, keeping the left columns and the added ones."""
    right = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *added)
    same = F.lit(True)
    for name in names:
        same = same & left[name].eqNullSafe(right[f"_r_{name}"])
    return left.join(right, same, how).drop(*[f"_r_{n}" for n in names])


def slice_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition on (keys, order) and write the result with its slice number.

    Slices are numbered in range order. They are written once, because sampling the range bounds again could cut the
    rows elsewhere.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(_SLICE, F.spark_partition_id())
    return materialize(ranged, "slices")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``position`` (1-based) and ``group_size``; the order has to be total.

    With ``ties``, columns the order starts with, also add ``first_position`` and ``last_position`` among the rows that
    agree in them.
    """
    sliced = slice_groups(df, keys, order)
    keys = list(keys)
    counts = sliced.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    # One row per group and slice: the windows below see at most as many rows per group as there are slices.
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        counts.withColumns({
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_total": F.sum("_n").over(whole),
        })
        .where(F.col("_total") > F.col("_n"))
        .select(*keys, _SLICE, "_before", "_total")
    )
    local = Window.partitionBy(*keys, _SLICE)
    numbered = sliced.withColumns({
        "_local": F.row_number().over(local.orderBy(*order)),
        "_local_n": F.count(F.lit(1)).over(local),
    })
    placed = (
        _keep_left(numbered, F.broadcast(shared), [*keys, _SLICE], ["_before", "_total"], "left")
        .withColumns({
            "position": (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"),
            "group_size": F.coalesce("_total", "_local_n").cast("bigint"),
        })
        .drop("_local", "_local_n", "_before", "_total")
    )
    if not ties:
        return placed.drop(_SLICE)
    # Equal rows stand side by side, so a run of them crosses a slice border at most once per border.
    runs = (
        placed.groupBy(*keys, *ties)
        .agg(
            F.min("position").alias("_first"), F.max("position").alias("_last"),
            (F.min(_SLICE) < F.max(_SLICE)).alias("_crosses"),
        )
        .where("_crosses")
    )
    alike = Window.partitionBy(*keys, _SLICE, *ties)
    inside = placed.withColumns({"_low": F.min("position").over(alike), "_high": F.max("position").over(alike)})
    return (
        _keep_left(inside, F.broadcast(runs), [*keys, *ties], ["_first", "_last"], "left")
        .withColumns({"first_position": F.coalesce("_first", "_low"), "last_position": F.coalesce("_last", "_high")})
        .drop("_first", "_last", "_low", "_high", _SLICE)
    )


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Column, name: str) -> DataFrame:
    """Add the value of ``take`` (never NULL) on the next row of the group in ascending order, NULL on the last row."""
    keys, order = list(keys), [F.col(c) for c in order]
    sliced = slice_groups(df.withColumn("_take", take), keys, order)
    first = sliced.groupBy(*keys, _SLICE).agg(F.min_by("_take", F.struct(*order)).alias("_first"))
    following = (
        first.withColumn("_after", F.lead("_first").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_SLICE)))
        .where(F.col("_after").isNotNull())
        .select(*keys, _SLICE, "_after")
    )
    local = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    led = sliced.withColumn("_led", F.lead("_take").over(local))
    joined = _keep_left(led, F.broadcast(following), [*keys, _SLICE], ["_after"], "left")
    return joined.withColumn(name, F.coalesce("_led", "_after")).drop("_take", "_led", "_after", _SLICE)


def latest_by_key(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the values of the row that comes last. Aggregates before the shuffle, so hot keys are harmless."""
    if len(values) == 1:
        return df.groupBy(*keys).agg(F.max_by(values[0], order).alias(values[0]))
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"))
    return packed.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def with_day_ranges(df: DataFrame, keys: Sequence[str], day: str, value: str, ranges: dict[str, int], unique: bool = False) -> DataFrame:
    """Per key and day the sum and number of values, and for each name of ``ranges`` the mean over so many days up to the day.

    Days without a row are not made up; both ends of a range count; NULL values are in no mean. The rows are reduced to one per
    key and day first, unless they are ``unique``: beside the aggregate that made them so, another one would only fill a task's
    memory with two more hash tables. A range that reaches back over the border of a slice finds the rows it needs in a copy of the last days
    before that slice, at most one row a day and border, so that a key with most of the rows spreads over all slices.
    """
    keys = list(keys)
    dated = df.where(F.col(day).isNotNull())
    if unique:
        daily = dated.select(*keys, day, F.col(value).alias("_sum"), F.col(value).isNotNull().cast("bigint").alias("_n"))
    else:
        daily = dated.groupBy(*keys, day).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    sliced = slice_groups(daily, keys, [F.col(day)])
    longest = max(ranges.values())
    spans = sliced.groupBy(*keys, _SLICE).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    # One row per group and slice; pairs of slices meet only where a range reaches from one into the other.
    spans = materialize(spans, "spans")
    earlier = spans.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col(_SLICE).alias("_from"), F.col("_last").alias("_until"))
    same = F.col("_from") < F.col(_SLICE)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    since = F.date_sub("_first", longest)
    reach = spans.join(earlier, same).where(F.col("_until") >= since).select(
        *keys, F.col(_SLICE).alias("_to"), F.col("_from").alias(_SLICE), since.alias("_since"))
    carried = _keep_left(sliced, reach, [*keys, _SLICE], ["_to", "_since"], "inner").where(F.col(day) >= F.col("_since"))
    own = sliced.withColumn("_own", F.lit(True))
    both = own.unionByName(carried.select(*[c for c in sliced.columns if c != _SLICE], F.col("_to").alias(_SLICE), F.lit(False).alias("_own")))
    back = Window.partitionBy(*keys, _SLICE).orderBy(F.unix_date(day))
    means = {
        name: F.try_divide(F.sum("_sum").over(w), F.sum("_n").over(w))
        for name, w in ((name, back.rangeBetween(-days, 0)) for name, days in ranges.items())
    }
    return both.withColumns(means).where("_own").drop("_own", _SLICE)
