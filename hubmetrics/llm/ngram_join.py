"""Exact n-gram Jaccard join that gives components: size-banded tiles, bitmap bounds, exact intersections.

Rows with equal shingle sets are one node. Two sets as similar as asked for share one of the first few shingles of each
under any order that all rows agree on; here the shingles of rarest hash buckets come first, so that passages which very
many documents share are seldom looked up. Nodes meet in tiles of (shared shingle, size band), a busy shingle's tiles being
split into pairs of blocks. In a tile a hashed bitmap per node bounds the overlap of two sets from above: each bit set on
one side only stands for an element the other side lacks. What survives is only connected, not listed in pairs, to
candidate clusters. In these, again in tiles of bounded bytes, the sorted sets themselves are intersected; a node is
compared with nodes it is not yet connected to, so a group of thousands of near copies needs few comparisons while no
connection between different texts is lost.

Shingles are compared by 64-bit hashes, sets by a 64-bit hash of the sorted shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubmetrics.llm.common import bound_batches, emit_rows, map_rows, words_of
from hubmetrics.llm.graph import components
from hubmetrics.storage import materialize

#: Hash buckets in which shingles are counted; the order of shingles follows the counts.
COUNT_BITS = 18
#: Bits of a bitmap: three for every four elements of the set or more, between these bounds (powers of two).
MIN_BITS, MAX_BITS = 1 << 8, 1 << 12
#: Nodes of one block of a busy shingle, and bytes of sets of one block of a large cluster.
BLOCK_NODES = 2048
BLOCK_BYTES = 8 << 20
#: Bits of the map that tells which rows' sets are wanted again. A full map only lets more rows through.
WANTED_BITS = 1 << 22

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; shorter texts are one shingle, texts without words have none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1 + len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    size = len(words) - n + 1
    out = hashes[:size] * _P1
    for k in range(1, n):
        out = _mixed(out + hashes[k: k + size]) * _P3
    return np.unique(_mixed(out))


def set_key(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)))))


def bitmap(shingles: np.ndarray) -> bytes:
    bits = MIN_BITS
    while bits < min(3 * len(shingles) // 4, MAX_BITS):
        bits *= 2
    flags = np.zeros(bits, np.uint8)
    flags[(shingles >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def needed(a: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap that makes sets of these sizes similar: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """A partner shares at least this many of the row's elements, so one of the first ``size - that + 1`` is shared."""
    return size - -(-percent * size // 100) + 1


def _bucket_counts(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many rows have a shingle in each bucket; a table of fixed size, whatever the number of rows."""
    def make():
        counts = np.zeros(1 << COUNT_BITS, np.int64)

        def run(texts=None):
            if texts is None:
                full = np.flatnonzero(counts)
                yield {"bucket": full, "n": counts[full]}
                return
            for t in texts:
                found = (shingle_set(t, n) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                np.add.at(counts, found, 1) if len(found) < 4096 else np.add(
                    counts, np.bincount(found, minlength=len(counts)), out=counts)
            yield from ()

        return run

    rows = emit_rows(docs, [text], [T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())], make)
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _signed_rows(docs: DataFrame, keep: list[str], text: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``keep, n, node, bits, prefix`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))

    def make():
        order = shared.value

        def run(texts):
            out = {"n": [], "node": [], "bits": [], "prefix": []}
            for t in texts:
                s = shingle_set(t, n)
                out["n"].append(len(s))
                if not len(s):
                    out["node"].append(None), out["bits"].append(None), out["prefix"].append(None)
                    continue
                rank = np.lexsort((s, order[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                out["node"].append(set_key(s))
                out["bits"].append(bitmap(s))
                out["prefix"].append(s[rank[: prefix_length(len(s), percent)]].view(np.int64))
            return out

        return run

    return map_rows(docs, keep, [text], [
        T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bits", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ], make)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to ``width`` bytes; set positions are hashes modulo a power of two."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tile:
    """Rows of one tile, sorted by size, with bitmaps grouped by width."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]):
        self.sizes = sizes
        self.width = np.array([len(b) for b in bits])
        self.all = {int(w): np.frombuffer(b"".join(b for b in bits if len(b) == w), np.uint8).reshape(-1, int(w))
                    for w in np.unique(self.width)}
        self.at = np.zeros(len(bits), np.int64)
        for w in self.all:
            mine = self.width == w
            self.at[mine] = np.arange(mine.sum())
        self.bits = bits

    def may_link(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` can reach the overlap that row ``i`` needs, by size and by bits."""
        size = int(self.sizes[i])
        sizes = self.sizes[others]
        least = needed(size, sizes, percent)
        others = others[(least <= size) & (least <= sizes)]
        out = []
        for w, table in self.all.items():
            mine = others[self.width[others] == w]
            if not len(mine):
                continue
            width = min(w, int(self.width[i]))
            own = _folded(np.frombuffer(self.bits[i], np.uint8)[None, :], width).view(np.uint64)
            theirs = np.ascontiguousarray(_folded(table[self.at[mine]], width)).view(np.uint64)
            only_own = np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64)
            only_theirs = np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64)
            most = np.minimum(size - only_own, self.sizes[mine] - only_theirs)
            out.append(mine[most >= needed(size, self.sizes[mine], percent)])
        return np.sort(np.concatenate(out)) if out else others[:0]


def spanning_links(count: int, linked) -> list[tuple[int, int]]:
    """Edges that connect rows 0..count-1 as all their links would; ``linked(i, others)`` says which others link to i."""
    edges = []
    left = np.arange(count)
    while len(left):
        queue = [int(left[0])]
        left = left[1:]
        for i in queue:
            if not len(left):
                break
            met = linked(i, left)
            if len(met):
                edges += [(i, int(j)) for j in met]
                queue += met.tolist()
                left = left[~np.isin(left, met)]
    return edges


def grouped_rows(
    rows: DataFrame, keys: list[str], values: list[str], out: list[T.StructField], make,
) -> DataFrame:
    """Bring the rows of each key into one task, sorted, and hand them over key by key.

    ``make`` gives a function from lists of the values of one key to a dictionary of lists, or None. Keys must be long
    columns whose groups are bounded.
    """
    bound_batches(rows.sparkSession)
    schema = T.StructType(out)
    arrow = to_arrow_schema(schema)
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        held: list[pa.RecordBatch] = []
        held_key = None
        pending: dict[str, list] = {f.name: [] for f in out}

        def take(parts):
            got = work(*[sum((p.column(k + i).to_pylist() for p in parts), []) for i in range(len(values))])
            if got:
                for name, x in got.items():
                    pending[name] += x

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                key = tuple(int(c[a]) for c in columns)
                if held and key != held_key:
                    take(held)
                    held = []
                held_key = key
                held.append(batch.slice(a, b - a))
            if len(pending[out[0].name]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(pending[f.name], f.type) for f in arrow], schema=arrow)
                pending = {f.name: [] for f in out}
        if held:
            take(held)
        yield pa.RecordBatch.from_arrays([pa.array(pending[f.name], f.type) for f in arrow], schema=arrow)

    dealt = rows.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


_EDGE = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]


def _edges_of(nodes: list[int], pairs: list[tuple[int, int]]) -> dict[str, list]:
    return {"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}


def _block_tiles(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Tiles ``i, j`` (i <= j) of pairs of blocks: every two rows of a key meet in at least one."""
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col(blocks)).cast("bigint")
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col(blocks).cast("bigint") - 1),
        lambda x: F.struct(F.least(x, F.col("_own")).alias("i"), F.greatest(x, F.col("_own")).alias("j")),
    )
    # With two blocks or more the tiles (i, i) are contained in others.
    wanted = F.when(F.col(blocks) > 1, F.filter(pairs, lambda p: p["i"] < p["j"])).otherwise(pairs)
    return rows.withColumn("_own", own).withColumn("_tile", F.explode(wanted)).withColumns(
        {"i": F.col("_tile.i"), "j": F.col("_tile.j")}).drop("_own", "_tile")


def candidate_edges(signed: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between nodes that connect all nodes whose sets may be similar."""
    known = signed.where("node IS NOT NULL")
    tokens = known.select("node", F.explode("prefix").alias("token"))
    two = F.col("c") == 2
    shared = materialize(
        tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("c"))
        .where("lo <> hi")
        .select(F.when(~two, F.col("token")).alias("token"), F.ceil(F.col("c") / BLOCK_NODES).alias("blocks"),
                F.when(two, F.col("lo")).alias("lo"), F.when(two, F.col("hi")).alias("hi")), "shingles")
    sheets = known.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    # Most shared shingles are shared by two rows. Such a pair meets once, however many shingles it shares, and only if
    # its sizes allow a link.
    sizes = sheets.select("node", "n")
    pairs = (
        shared.where("lo IS NOT NULL").select("lo", "hi").distinct()
        .join(sizes.select(F.col("node").alias("lo"), F.col("n").alias("n_lo")), "lo")
        .join(sizes.select(F.col("node").alias("hi"), F.col("n").alias("n_hi")), "hi")
        .where(100 * F.least("n_lo", "n_hi") >= percent * F.greatest("n_lo", "n_hi"))
        .select(F.explode(F.array("lo", "hi")).alias("node"), F.xxhash64("lo", "hi").alias("token"),
                F.lit(1).cast("bigint").alias("blocks"), F.lit(True).alias("pair"))
    )
    groups = tokens.join(shared.where("token IS NOT NULL").select("token", "blocks"), "token").distinct()
    met = groups.select("node", "token", "blocks", F.lit(False).alias("pair")).unionByName(pairs).join(sheets, "node")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("bigint")
    # Similar sets lie in the same band or in neighbouring ones, so each row also visits the band above its own.
    # A pair needs one tile only.
    bands = F.when(F.col("pair"), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(band, band + 1))
    tiles = _block_tiles(met.withColumn("band", F.explode(bands)), "token", "blocks")

    def make():
        def run(nodes, sizes, bits):
            if len(nodes) < 2:
                return None
            order = np.argsort(sizes, kind="stable")
            tile = Tile(np.asarray(sizes, np.int64)[order], [bits[x] for x in order])
            pairs = spanning_links(len(nodes), lambda i, others: tile.may_link(i, others, percent))
            return _edges_of([nodes[x] for x in order], pairs)

        return run

    return grouped_rows(tiles, ["token", "band", "i", "j"], ["node", "n", "bits"], _EDGE, make).distinct()


def _wanted_map(ids: DataFrame) -> np.ndarray:
    slot = F.pmod("h", F.lit(WANTED_BITS))
    rows = ids.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {WANTED_BITS}) & 63 AS int))")).alias("b")).toArrow()
    words = np.zeros(WANTED_BITS // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return words.view(np.uint64)


def _wanted_sets(docs: DataFrame, key: str, text: str, n: int, wanted: np.ndarray) -> DataFrame:
    """``node, items``: the sets of the rows whose key, a hash, is in the map."""
    words = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        bits = words.value

        def run(hashes=None, texts=None):
            if hashes is None:
                return
            slot = np.asarray(hashes, np.int64) % WANTED_BITS
            hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            out = {"node": [], "items": []}
            for i in np.flatnonzero(hit):
                s = shingle_set(texts[i], n)
                if len(s):
                    out["node"].append(set_key(s))
                    out["items"].append(s.tobytes())
            yield out

        return run

    return emit_rows(docs, [key, text], [T.StructField("node", T.LongType()), T.StructField("items", T.BinaryType())], make)


def exact_links(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between similar sets that connect each cluster as all its links would."""
    sized = clusters.groupBy("component").agg(F.ceil(8 * F.sum("n") / BLOCK_BYTES).alias("blocks"))
    rows = _block_tiles(sets.join(clusters.join(sized, "component"), "node"), "component", "blocks")

    def make():
        def run(nodes, items):
            if len(nodes) < 2:
                return None
            arrays = [np.frombuffer(x, np.uint64) for x in items]
            order = sorted(range(len(nodes)), key=lambda x: (len(arrays[x]), nodes[x]))
            arrays = [arrays[x] for x in order]
            tile = Tile(np.array([len(a) for a in arrays], np.int64), [bitmap(a) for a in arrays])

            def linked(i, others):
                met = tile.may_link(i, others, percent)
                if not len(met):
                    return met
                own, theirs = arrays[i], [arrays[j] for j in met]
                ends = np.cumsum([len(x) for x in theirs])
                joined = np.concatenate(theirs)
                at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                common = np.diff(np.concatenate([[0], np.cumsum(own[at] == joined)[ends - 1]]))
                return met[100 * common >= percent * (len(own) + tile.sizes[met] - common)]

            return _edges_of([nodes[x] for x in order], spanning_links(len(nodes), linked))

        return run

    return grouped_rows(rows, ["component", "i", "j"], ["node", "items"], _EDGE, make)


def ngram_components(
    docs: DataFrame, n: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text",
    row_column: str | None = None,
) -> DataFrame:
    """``id, n_shingles, component_id, kept, _row`` of each row of ``docs``.

    Rows link when 100 * intersection >= percent * union of their sets of ``n``-word shingles. ``component_id`` is the
    smallest id reachable by links, ``kept`` is true for one row of each component (smallest id, then the first row), and
    ``_row`` numbers the rows as ``monotonically_increasing_id`` does, unless ``docs`` has numbers of its own, all of them
    different, in ``row_column``; the result then has that column instead. NULL, empty and blank texts have no shingles and
    link with nothing: they are their own component and kept. Repeated rows are linked with each other. A NULL id is
    never the smallest while another id is there. An empty table gives no rows; other columns do not matter.
    """
    source = docs.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"),
        (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("_row"),
        # A row's content finds it again, even if a second reading deals rows to other partitions.
        F.xxhash64(id_column, text_column).alias("_h"))
    counts = _bucket_counts(source, "_text", n)
    signed = materialize(_signed_rows(source, ["_id", "_row", "_h"], "_text", n, percent, counts), "signed")
    # NULL ids sort last in the smallest (id, row).
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"),
                           F.col("_h").alias("h")))
    nodes = materialize(
        signed.where("node IS NOT NULL").groupBy("node").agg(first.alias("first"), F.max("n").alias("n")), "nodes")
    clusters = materialize(
        components(candidate_edges(signed, percent)).join(nodes, "node"), "clusters")
    wanted = _wanted_map(clusters.select(F.col("first.h").alias("h")))
    sets = _wanted_sets(source, "_h", "_text", n, wanted).dropDuplicates(["node"])
    links = exact_links(sets, clusters.select("node", "component", "n"), percent)
    linked = materialize(components(links).join(nodes.select("node", "first"), "node"), "linked")
    smallest = linked.groupBy("component").agg(F.min("first").alias("least"))
    answer = nodes.select("node", "first").join(
        linked.join(smallest, "component").select("node", "least"), "node", "left"
    ).select("node", F.coalesce("least", "first").alias("least"))
    placed = signed.select("_id", "_row", "n", "node").join(materialize(answer, "answer"), "node", "left")
    return placed.select(
        F.col("_id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("least.id")).alias("component_id"),
        (F.col("node").isNull() | (F.col("least.row") == F.col("_row"))).alias("kept"),
        F.col("_row").alias(row_column or "_row"),
    )
