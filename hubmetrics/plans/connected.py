"""Connected components by hooking and pointer jumping, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubmetrics.storage import materialize


def hooks(edges: DataFrame) -> list[DataFrame]:
    """Rounds (u, root) that lead every node of the edges (u, v) to the least node it is connected to, applied in turn.

    Each round hooks every label onto the least label next to it and then halves the way to the root, so long chains
    shrink fast. Minimum and join work on one row per label on at least one side.
    """
    edges = materialize(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root"))
        parent = _flatten(materialize(parent, "parents"))
        rounds.append(parent)
        named = (
            edges.join(parent.select("u", F.col("root").alias("ru")), "u")
            .join(parent.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v")
        )
        edges = materialize(
            named.where(F.col("ru") != F.col("rv"))
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(),
            "edges",
        )
    return rounds


def follow(nodes: DataFrame, column: str, rounds: Sequence[DataFrame]) -> DataFrame:
    """``nodes`` with ``column`` replaced by the least node that it is connected to."""
    for parent in rounds:
        nodes = nodes.join(parent.select(F.col("u").alias(column), "root"), column, "left").withColumn(
            column, F.coalesce("root", column)
        ).drop("root")
    return nodes


def _flatten(parent: DataFrame) -> DataFrame:
    """Follow parents to their roots; the distance to the root halves in every round."""
    while True:
        up = parent.select(F.col("u").alias("root"), F.col("root").alias("_up"))
        jumped = materialize(
            parent.join(up, "root").select("u", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")),
            "parents",
        )
        if jumped.where("moved").isEmpty():
            return jumped.select("u", "root")
        parent = jumped.select("u", "root")
