"""Near-duplicate embeddings by lattice hashing.

A table projects a unit vector onto a few blocks of eight random directions and decodes each block to the nearest point of
the E8 lattice; the points together are the vector's cell. A vector also visits the nearest neighbouring cells. Vectors that
share a cell in any table are compared by cosine in double precision. Cells that only one vector visits are sorted out by a
count before any vector is moved; busy cells are split into pairs of blocks of bounded size.

A link is counted in one cell only: the smallest of all that its two vectors share. So each vector's links are counted
where they are found, and no pair leaves its task; of the pairs only what connects the component is kept.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubmetrics.llm.common import map_rows
from hubmetrics.llm.graph import components
from hubmetrics.llm.ngram_join import grouped_rows, spanning_links
from hubmetrics.storage import materialize

TABLES = 6
#: Blocks of eight directions in a cell, cells visited beside the own one, and the lattice's scale. Together they find
#: about 0.99 of random pairs at a cosine of exactly 0.95 in 64 dimensions, and more of closer ones.
BLOCKS = 2
PROBES = 4
SCALE = 0.65
BLOCK_VECTORS = 1024


def lattice_points(x: np.ndarray, best: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``best`` nearest E8 points that rounding reaches, doubled to integers, and their squared distances.

    The lattice is the points with even coordinate sum of the integers and of the integers plus one half. In each of the
    two sets a sum of the wrong parity is mended by moving the coordinate that costs least; the next two are neighbours.
    """
    n = len(x)
    points, far = [], []
    for shift in (0.0, 0.5):
        r = np.rint(x - shift)
        e = x - shift - r
        order = np.argsort(-np.abs(e), axis=1, kind="stable")
        odd = (r.sum(axis=1).astype(np.int64) & 1).astype(bool)
        rows = np.arange(n)
        for choice in range(3):
            p = r.copy()
            one = order[:, choice]
            step = np.where(e >= 0, 1.0, -1.0)
            p[rows[odd], one[odd]] += step[rows[odd], one[odd]]
            if choice:
                even = ~odd
                for c in (order[:, 0], one):
                    p[rows[even], c[even]] += step[rows[even], c[even]]
            p += shift
            points.append((2 * p).astype(np.int16))
            far.append(((x - p) ** 2).sum(axis=1))
    points, far = np.stack(points, axis=1), np.stack(far, axis=1)
    pick = np.argsort(far, axis=1, kind="stable")[:, :best]
    return np.take_along_axis(points, pick[:, :, None], axis=1), np.take_along_axis(far, pick, axis=1)


def projection(dimension: int, tables: int, blocks: int) -> np.ndarray:
    """Fixed random directions for vectors of this dimension."""
    return np.random.default_rng(dimension * 1_000_003 + 17).standard_normal((tables, blocks, dimension, 8))


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell keys of unit vectors: an array (vectors, tables, 1 + probes) of 64-bit hashes, the own cell first."""
    n, dimension = unit.shape
    directions = projection(dimension, tables, blocks)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        found = [lattice_points(scale * (unit @ directions[t, b])) for b in range(blocks)]
        best = found[0][0].shape[1]
        ways = np.stack(np.meshgrid(*[np.arange(best)] * blocks, indexing="ij"), axis=-1).reshape(-1, blocks)
        cost = sum(found[b][1][:, ways[:, b]] for b in range(blocks))
        pick = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        for k in range(1 + probes):
            way = ways[pick[:, k]]
            rows = np.concatenate(
                [np.full((n, 1), t, np.int16), *[found[b][0][np.arange(n), way[:, b]] for b in range(blocks)]], axis=1)
            rows = np.ascontiguousarray(rows)
            out[:, t, k] = [np.int64(np.uint64(xxhash.xxh3_64_intdigest(r.tobytes(), dimension))) for r in rows]
    return out


def _unit_rows(source: DataFrame, vector: str) -> DataFrame:
    """Adds ``node`` (a hash of the vector, NULL if it links with nothing), ``unit`` and ``keys``, its cells."""
    def make():
        def run(vectors):
            out = {"node": [None] * len(vectors), "unit": [None] * len(vectors), "keys": [None] * len(vectors)}
            by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, v in enumerate(vectors):
                if not v or any(c is None for c in v):
                    continue
                x = np.array(v, float)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top  # so that no square overflows or vanishes
                    by_size.setdefault(len(x), []).append((i, x / np.sqrt((x * x).sum())))
            for group in by_size.values():
                found = cells(np.stack([u for _, u in group]))
                for (i, u), k in zip(group, found):
                    raw = u.tobytes()
                    out["node"][i] = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw))))
                    out["unit"][i] = raw
                    out["keys"][i] = k.ravel().tolist()
            return out

        return run

    return map_rows(source, ["_id", "_row"], [vector], [
        T.StructField("node", T.LongType()), T.StructField("unit", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ], make)


def similar_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``id, n_links, component_id, kept`` of each row of ``vectors``.

    Two rows link if they share a cell and their cosine is ``threshold`` or more; equal vectors always link. Vectors that
    are NULL, empty, zero, or hold NULL or a non-finite number link with nothing and are kept. Vectors of different
    dimension never link. A repeated id is a row of its own. ``component_id`` is the smallest id reachable by links.
    An empty table gives no rows; other columns do not matter.
    """
    source = vectors.select(
        F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(vector_column).alias("_v"))
    rows = materialize(_unit_rows(source, "_v"), "vectors")
    usable = rows.where("node IS NOT NULL")
    nodes = materialize(usable.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least")), "nodes")
    visits = usable.select("node", F.explode(F.array_distinct("keys")).alias("cell"))
    shared = (
        visits.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo <> hi").select("cell", F.ceil(F.col("n") / BLOCK_VECTORS).alias("blocks"))
    )
    met = visits.join(materialize(shared, "cells"), "cell").distinct()
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("blocks")).cast("bigint")
    # Every two blocks meet in one tile, and a single block in a tile of its own.
    tiles = met.withColumn("own", own).withColumn("_tile", F.explode(F.filter(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
                    lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))),
        lambda p: (p["i"] < p["j"]) | (F.col("blocks") == 1),
    ))).select("cell", F.col("_tile.i").alias("i"), F.col("_tile.j").alias("j"), "own", "node")
    sheets = usable.groupBy("node").agg(F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    full = tiles.join(sheets, "node").join(nodes.select("node", "copies"), "node")

    def make():
        def run(cell, i, j, own, node, unit, keys, copies):
            if len(node) < 2:
                return None
            sizes = {len(u) for u in unit}
            got = {"a": [], "b": [], "n": []}
            for size in sizes:
                mine = [k for k in range(len(node)) if len(unit[k]) == size]
                if len(mine) > 1:
                    x = np.stack([np.frombuffer(unit[k], float) for k in mine])
                    linked = x @ x.T >= threshold
                    np.fill_diagonal(linked, False)
                    if not linked.any():
                        continue
                    home = np.array([own[k] for k in mine])
                    low, high = i[0], j[0]
                    table = np.array([keys[k] for k in mine], np.int64)
                    weight = np.array([copies[k] for k in mine], np.int64)
                    a, b = np.nonzero(np.triu(linked))
                    same = home[a] == home[b]
                    ok = np.ones(len(a), bool)
                    if low != high:
                        # Block b > 0 counts its inner pairs in tile (0, b), block 0 in tile (0, 1).
                        ok = ~same | ((low == 0) & (home[a] == high)) | ((low == 0) & (high == 1) & (home[a] == 0))
                    a, b = a[ok], b[ok]
                    first = np.ones(len(a), bool)
                    for at in range(0, len(a), 8192):
                        p, q = table[a[at: at + 8192]], table[b[at: at + 8192]]
                        for t in range(TABLES):
                            s = slice(t * (1 + PROBES), (t + 1) * (1 + PROBES))
                            both = p[:, s][:, :, None] == q[:, s][:, None, :]
                            smaller = both & (p[:, s] < cell[0])[:, :, None]
                            first[at: at + 8192] &= ~smaller.any(axis=(1, 2))
                    a, b = a[first], b[first]
                    counts = np.bincount(a, weights=weight[b], minlength=len(mine)) + np.bincount(b, weights=weight[a], minlength=len(mine))
                    for k in np.flatnonzero(counts):
                        got["a"].append(node[mine[k]]), got["b"].append(None), got["n"].append(int(counts[k]))
                    for p, q in spanning_links(len(mine), lambda r, others: others[linked[r, others]]):
                        got["a"].append(node[mine[p]]), got["b"].append(node[mine[q]]), got["n"].append(0)
            return got

        return run

    out = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())]
    keyed = full.withColumns({"c": F.col("cell"), "ti": F.col("i"), "tj": F.col("j")})
    found = materialize(grouped_rows(
        keyed, ["c", "ti", "tj"], ["cell", "i", "j", "own", "node", "unit", "keys", "copies"], out, make), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    hung = materialize(components(found.where("b IS NOT NULL").select("a", "b")).join(nodes.select("node", "least"), "node"), "hung")
    smallest = hung.groupBy("component").agg(F.min("least").alias("_c"))
    answer = (
        nodes.join(counts, "node", "left").join(hung.join(smallest, "component").select("node", "_c"), "node", "left")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("_c", "least").alias("_c"))
    )
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("_c"))
    return rows.select("_id", "node").join(materialize(answer, "answer"), "node", "left").select(
        F.col("_id").alias(id_column), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"),
    )
