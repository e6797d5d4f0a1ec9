"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubmetrics.storage import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node onto its smallest neighbour.

    The smallest neighbour is an aggregate, so a node with very many edges shrinks before the shuffle; in the join back
    such a node stands on the side that adaptive execution can split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("n"))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has an edge.

    Large-star and small-star steps take turns until nothing changes, a number of rounds that grows with the logarithm
    of the longest path squared at most. Every round is written to the shared folder. Loops and repeated edges do not
    matter, edges with NULL are left out, no edges give no rows.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(f"{a} IS NOT NULL AND {b} IS NOT NULL").where("a <> b").distinct(), "edges")
    before = _state(now)
    while before[0]:
        now = materialize(_star(_star(now, True), False), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    hung = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return hung.union(roots.join(hung.select("node"), "node", "left_anti"))
