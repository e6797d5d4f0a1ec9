"""Ranked lexical search over a trie of documents.

Documents are reduced to the terms that some query item has. Within a task, their terms are ordered by document frequency,
rarest first, and documents that begin with the same terms share a path (an FP-tree). A node knows the largest frequency of its
own term and the smallest length measure m among the documents below it. An item is searched depth first from the nodes of its
rarest term: what such a subtree can score at most is the node's own share plus that of the item's more frequent terms, since
a document whose rarest term of the item is another one lies below that term's nodes. Subtrees that cannot reach the
item's best ``top`` so far are left out, the others are opened, best bound first, down to documents, which are scored exactly.

Bounds start from scores that a bounded number of documents really reach, so every task leaves out most of its trees. Items
are handled in blocks whose distinct terms are counted before they are broadcast. Nothing is cut: equal scores are kept until
the final ranking, a window that drops all but the first rows of each item before its shuffle.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubmetrics.llm.common import ALNUM_LOWER, bound_batches, emit_rows
from hubmetrics.plans.ordered import with_position
from hubmetrics.storage import materialize

TOP = 20
#: Items of a block, and distinct terms up to which a block is broadcast; larger blocks are halved down to one item.
BLOCK_ITEMS = 2000
BLOCK_TERMS = 200_000
#: Rows, at most about so many, whose scores are the first lower bounds.
SEED_ROWS = 16_384
#: Terms of documents that one tree holds.
TREE_TERMS = 2_000_000
#: Documents that first go down their paths together, each time four times so many; a node over more is opened further first.
LEAF = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split()


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of a term's weight, in millionths: rises with its frequency, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """Documents as sequences of (place in the order of rarity, frequency), sharing common beginnings."""

    def __init__(self, ends: np.ndarray, order: np.ndarray, tf: np.ndarray, m: np.ndarray, places: int):
        """``order`` and ``tf`` hold the terms of all documents, each document's in rising order; ``ends`` their ends."""
        docs = len(ends)
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        # What each document gets from each of its terms, term by term.
        by = np.argsort(order, kind="stable")
        self.post = np.searchsorted(order[by], np.arange(places + 1))
        self.post_doc = np.repeat(np.arange(docs), size)[by]
        self.post_gain = gain(tf, np.repeat(m, size))[by]
        self.m = m
        slots = np.arange(docs)  # slots of documents whose path still branches, node by node
        group = np.zeros(docs, np.int64)
        perm = np.arange(docs)
        depth = np.full(docs, -1)  # terms of each document that stand in shared nodes
        nodes: list[tuple] = []
        first_node, parent_of = 1, np.zeros(docs, np.int64)
        d = 0
        while len(slots):
            some = perm[slots]
            here = size[some] > d
            o = np.where(here, order[np.minimum(starts[some] + d, len(order) - 1)] if len(order) else -1, -1)
            by = np.lexsort((o, group))
            some, o, group, parent_of = some[by], o[by], group[by], parent_of[by]
            perm[slots] = some
            new = np.ones(len(slots), bool)
            new[1:] = (group[1:] != group[:-1]) | (o[1:] != o[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.concatenate([begin, [len(slots)]]))
            ended = o[begin] < 0
            depth[some[np.repeat(ended | (count == 1), count)]] = d
            shared = ~ended & (count > 1)
            b, c = begin[shared], count[shared]
            keep = np.repeat(shared, count)
            number = np.repeat(first_node + np.arange(len(b)), c)
            if len(b):
                at = starts[some[keep]] + d
                edges = np.concatenate([[0], np.cumsum(c)[:-1]])
                nodes.append((o[b], slots[b], slots[b] + c, np.maximum.reduceat(tf[at], edges),
                              np.minimum.reduceat(m[some[keep]], edges), parent_of[b]))
            first_node += len(b)
            slots, group, parent_of = slots[keep], number, number
            d += 1
        self.docs = perm
        slot_of = np.empty(docs, np.int64)
        slot_of[perm] = np.arange(docs)
        # What follows the last shared node of a document is a path of its own: one node over one document for each term.
        place = np.arange(len(order)) - np.repeat(starts, size)
        own = np.flatnonzero(place >= np.repeat(depth, size))
        doc = np.repeat(np.arange(docs), size)[own]
        at = slot_of[doc]
        columns = list(zip(*nodes)) if nodes else [[]] * 6
        o = np.concatenate([*columns[0], order[own]]).astype(np.int64)
        low = np.concatenate([*columns[1], at]).astype(np.int64)
        high = np.concatenate([*columns[2], at + 1]).astype(np.int64)
        most = np.concatenate([*columns[3], tf[own]]).astype(np.int64)
        least = np.concatenate([*columns[4], m[doc]]).astype(np.int64)
        # Header table: the nodes of each term side by side.
        header = np.argsort(o, kind="stable")
        self.header = np.searchsorted(o[header], np.arange(places + 1))
        self.low, self.high, self.most, self.least = low[header], high[header], most[header], least[header]
        # Children of shared nodes among shared nodes, for opening large subtrees.
        parent = np.concatenate([np.zeros(0, np.int64), *columns[5]]).astype(np.int64) - 1
        back = np.empty(len(o), np.int64)
        back[header] = np.arange(len(o))
        self.children: dict[int, np.ndarray] = {}
        inner = np.flatnonzero(parent >= 0)
        inner = inner[np.argsort(parent[inner], kind="stable")]
        for part in np.split(inner, np.flatnonzero(np.diff(parent[inner])) + 1) if len(inner) else []:
            self.children[int(back[parent[part[0]]])] = back[part]
        self.place = o[header]
        edges = np.flatnonzero(np.diff(self.header) > 0)
        self.top_tf, self.top_gain, self.low_m = np.zeros(places, np.int64), np.zeros(places, np.int64), np.full(places, 1 << 40)
        if len(o):
            self.top_tf[edges] = np.maximum.reduceat(self.most, self.header[edges])
            self.top_gain[edges] = np.maximum.reduceat(self.post_gain, self.post[edges])
            self.low_m[edges] = np.minimum.reduceat(self.least, self.header[edges])
        self.low_after = np.minimum.accumulate(self.low_m[::-1])[::-1]  # of a term and all that are more frequent

    def _down(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the documents that reach ``floor``: down their paths, from one term of the item to the next.

        A document is left as soon as the terms it has shown and the most that the others could give stay below.
        """
        score = np.zeros(len(docs), np.int64)
        most = weights * np.minimum(gain(self.top_tf[places], self.m[docs][:, None]), self.top_gain[places])
        rest = np.cumsum(most[:, ::-1], axis=1)[:, ::-1]
        for k, (o, w) in enumerate(zip(places.tolist(), weights.tolist())):
            there = self.post_doc[self.post[o]: self.post[o + 1]]
            at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
            hit = np.flatnonzero(there[at] == docs)
            score[hit] += w * self.post_gain[self.post[o] + at[hit]]
            keep = score + (rest[:, k + 1] if k + 1 < len(places) else 0) >= floor
            if not keep.all():
                docs, score, rest = docs[keep], score[keep], rest[keep]
                if not len(docs):
                    break
        return docs, score

    def _open(self, node: int, j: int, places: np.ndarray, weights: np.ndarray, so_far: int, floor: int) -> list[np.ndarray]:
        """Documents below a large node whose subtrees can reach ``floor``: depth first, one child after the other.

        ``so_far`` is what the item's terms on the path give at most, ``j`` the first term of the item not yet passed.
        """
        out, stack = [], [(node, j, so_far)]
        while stack:
            node, j, so_far = stack.pop()
            low, high = int(self.low[node]), int(self.high[node])
            m = int(self.least[node])
            if so_far + int((weights[j:] * gain(self.top_tf[places[j:]], m)).sum()) < floor:
                continue
            below = self.children.get(node)
            if below is None or high - low <= LEAF:
                out.append(self.docs[low:high])
                continue
            covered = low
            for child in below[np.argsort(self.low[below])].tolist():
                out.append(self.docs[covered: self.low[child]])  # documents that end here or go on alone
                covered = int(self.high[child])
                at = int(np.searchsorted(places, self.place[child]))  # terms before it are on no path below it
                own = so_far
                if at < len(places) and places[at] == self.place[child]:
                    if at >= j:
                        own += int(weights[at] * gain(self.most[child], self.least[child]))
                    at += 1
                stack.append((child, max(at, j), own))
            out.append(self.docs[covered:high])
        return out

    def _reachable(self, places: np.ndarray, weights: np.ndarray, floor: list[int]) -> Iterator[np.ndarray]:
        """Documents of the subtrees that can reach the floor as it is when they are asked for, best bounds of a term first."""
        for j, o in enumerate(places.tolist()):
            later, w = places[j + 1:], weights[j + 1:]
            if int((weights[j:] * gain(self.top_tf[places[j:]], self.low_after[o])).sum()) < floor[0]:
                return  # nor can a document that has only terms behind this one
            nodes = np.arange(self.header[o], self.header[o + 1])
            own = weights[j] * gain(self.most[nodes], self.least[nodes])
            on = np.flatnonzero(own + int((w * gain(self.top_tf[later], self.low_m[o])).sum()) >= floor[0])
            nodes, bound = nodes[on], own[on]
            bound = bound + (w * gain(self.top_tf[later], self.least[nodes][:, None])).sum(axis=1)
            on = np.flatnonzero(bound >= floor[0])
            nodes, own, bound = nodes[on], own[on], bound[on]
            wide = self.high[nodes] - self.low[nodes] > LEAF
            low, size = self.low[nodes[~wide]], self.high[nodes[~wide]] - self.low[nodes[~wide]]
            yield self.docs[np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)]
            for k in np.flatnonzero(wide)[np.argsort(-bound[wide], kind="stable")].tolist():
                if bound[k] >= floor[0]:
                    yield np.concatenate([np.zeros(0, np.int64), *self._open(int(nodes[k]), j + 1, places, weights, int(own[k]), floor[0])])

    def search(self, places: np.ndarray, weights: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all that score ``floor`` or more, or else enough to hold the best ``top`` of these with ties.

        ``places`` rise. Documents without a term of the item are never returned.
        """
        some = self.top_tf[places] > 0
        places, weights = places[some], weights[some]
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(places):
            return found, score
        seen = np.zeros(len(self.docs), bool)
        now = [max(floor, 1)]
        held: list[np.ndarray] = []
        size, enough = 0, LEAF

        def score_held():
            nonlocal found, score
            docs = np.unique(np.concatenate(held))
            docs = docs[~seen[docs]]
            seen[docs] = True
            docs, got = self._down(docs, places, weights, now[0])
            found, score = np.concatenate([found, docs]), np.concatenate([score, got])
            if len(found) >= top:
                now[0] = max(now[0], int(-np.partition(-score, top - 1)[top - 1]))
                keep = score >= now[0]
                found, score = found[keep], score[keep]

        for docs in self._reachable(places, weights, now):
            held.append(docs)
            size += len(docs)
            if size >= enough:
                score_held()
                held, size, enough = [], 0, 4 * enough
        if held:
            score_held()
        return found, score


class Items:
    """The items of a block: places of their terms in the order of rarity, and weights with repeats."""

    def __init__(self, terms: list[list[tuple[int, int]]], df: np.ndarray, total: int):
        """``terms`` has (number of a term, repeats) for each item."""
        self.order = np.empty(len(df), np.int64)
        self.order[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
        weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()]
        self.places, self.weights = [], []
        for some in terms:
            some = sorted((int(self.order[t]), k * weight[t]) for t, k in some if df[t])
            self.places.append(np.array([s[0] for s in some], np.int64))
            self.weights.append(np.array([s[1] for s in some], np.int64))
        self.floor = np.zeros(len(terms), np.int64)


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, id, term, times``: one row per item and distinct term."""
    out = [T.StructField("item", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("times", T.LongType())]

    def make():
        def run(rows=None, texts=None):
            for row, text in zip(rows or [], texts or []):
                counts = collections.Counter(terms_of(text))
                if counts:
                    yield {"item": [row] * len(counts), "term": list(counts), "times": list(counts.values())}

        return run

    return emit_rows(items, ["_item", "_text"], out, make)


def _vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``id, row, n, terms, tfs``: the terms of the vocabulary that each row has, by number, and how often."""
    bound_batches(docs.sparkSession)
    long, ints = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("id", docs.schema["_id"].dataType), T.StructField("row", long), T.StructField("n", long),
        T.StructField("terms", ints), T.StructField("tfs", ints)])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # BLOCK_TERMS terms, or those of one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(shared.value)}
        for batch in batches:
            n, ends, terms, tfs = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for text in batch.column(2):
                words = terms_of(text.as_py())
                n.append(len(words))
                found = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                found, times = np.unique(found[found >= 0], return_counts=True)
                terms.append(found)
                tfs.append(times.astype(np.int32))
                ends.append(ends[-1] + len(found))
            lists = [pa.ListArray.from_arrays(np.array(ends, np.int32), np.concatenate(x)) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), batch.column(1), pa.array(n, pa.int64()), *lists], schema=arrow)

    return docs.select("_id", "_row", "_text").mapInArrow(run, schema)


def _best(vectors: DataFrame, items: Items, mean: tuple[int, int], top: int) -> DataFrame:
    """``item, score, id, row``: for each item the best rows of each task, none that cannot be among the best of all."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema["id"].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("item", long), T.StructField("score", long), T.StructField("id", kind), T.StructField("row", long)])
    arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(items)
    count, words = mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        floor = block.floor.copy()
        best: list[list[tuple]] = [[] for _ in floor]

        def search(held: list[pa.RecordBatch]) -> None:
            ids = [x for b in held for x in b.column(0).to_pylist()]
            rows = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
            n = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held])
            size = np.concatenate([np.diff(b.column(3).offsets.to_numpy()) for b in held])
            order = block.order[np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in held])]
            tf = np.concatenate([b.column(4).flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            by = np.argsort(np.repeat(np.arange(len(size)), size) * len(block.order) + order, kind="stable")
            m = 100 - 25 + (25 * n * count) // words
            tree = Tree(np.cumsum(size), order[by], tf[by], m, len(block.order))
            for k, (places, weights) in enumerate(zip(block.places, block.weights)):
                docs, score = tree.search(places, weights, int(floor[k]), top)
                if len(docs):
                    new = [(-s, ids[d] is None, ids[d], r) for d, s, r in zip(docs.tolist(), score.tolist(), rows[docs].tolist())]
                    best[k] = sorted([*best[k], *new], key=_rank)[:top]
                    if len(best[k]) == top:
                        floor[k] = max(floor[k], -best[k][-1][0])

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                held.append(part)
                size += len(part.column(3).flatten())
                if size >= TREE_TERMS:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        for k, some in enumerate(best):
            if some:
                yield pa.RecordBatch.from_arrays([
                    pa.array([k] * len(some), pa.int64()), pa.array([-s[0] for s in some], pa.int64()),
                    pa.array([s[2] for s in some], arrow.field(2).type), pa.array([s[3] for s in some], pa.int64())], schema=arrow)

    def _rank(x: tuple) -> tuple:
        return (x[0], x[1], x[3]) if x[1] else x

    return vectors.where(F.size("terms") > 0).mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, names: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """``item, rank, id, score`` for the items of one block."""
    vocabulary = sorted(bytes(r["term"]) for r in terms.select("term").distinct().collect())
    number = {w: k for k, w in enumerate(vocabulary)}
    block: dict[int, list] = {}
    for r in terms.collect():  # as many rows as the block's items have distinct terms
        block.setdefault(r["item"], []).append((number[bytes(r["term"])], r["times"]))
    vectors = materialize(_vectors(docs, vocabulary), "vectors")
    row = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("words"), F.count(F.lit(1)).alias("rows")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term
        df[r["t"]] = r["count"]
    keys = sorted(block)
    items = Items([block[k] for k in keys], df, row["docs"] or 0)
    mean = row["docs"] or 0, max(row["words"] or 0, 1)
    share = SEED_ROWS / max(row["rows"], 1)
    if share < 0.5:
        some = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)))
        for r in _ranked(_best(some, items, mean, top), top).where(F.col("rank") == top).collect():  # one row an item
            items.floor[r["item"]] = r["score"]
    best = materialize(_best(vectors, items, mean, top), "best")
    back = vectors.sparkSession.createDataFrame(list(enumerate(keys)), "item long, _item long")
    return _ranked(best, top).join(back, "item").select("_item", "rank", "id", "score").join(names, "_item")


def lexical_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` rows of ``docs`` with the highest scores above 0 for each row of ``items``.

    Equal scores are ranked by smaller id (NULL last), then by the order of the rows. NULL and empty texts have no terms: such
    rows are never found and do not count as documents, and such items have no result. Repeated rows of either table count each;
    an empty table gives no rows. Texts of any length are read whole. Other columns do not matter.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_column).alias("_text"))
    asked = materialize(with_position(
        items.select(F.col(item_column).alias("_name"), F.col(item_text).alias("_text"), F.monotonically_increasing_id().alias("_i")),
        [], [F.col("_i")]).withColumnRenamed("position", "_item").drop("_i", "group_size"), "items")
    terms = materialize(_item_terms(asked), "terms")
    count, start, out = asked.count(), 1, None
    while start <= count:
        size = BLOCK_ITEMS
        while True:
            some = terms.where(F.col("item").between(start, start + size - 1))
            if size == 1 or some.select("term").distinct().count() <= BLOCK_TERMS:
                break
            size //= 2
        names = asked.where(F.col("_item").between(start, start + size - 1)).select("_item", "_name")
        part = _search_block(source, names, some, top)
        out = part if out is None else out.unionByName(part)
        start += size
    if out is None:
        kind = {f.name: f.dataType for f in [*source.schema, *asked.schema]}
        out = spark.createDataFrame([], T.StructType([
            T.StructField("rank", T.IntegerType()), T.StructField("id", kind["_id"]), T.StructField("score", T.LongType()), T.StructField("_name", kind["_name"])]))
    return out.select(F.col("_name").alias(item_column), F.col("rank"), F.col("id").alias(id_column), "score")
