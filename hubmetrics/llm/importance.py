"""Importance resampling towards a target collection, by hashed word runs.

Runs of one to three words of all documents and of the target are counted by bucket; a bucket's gain is the logarithm of how
much more often the target has it, and a document's weight is the sum of the gains of its runs, looked up in one array.
Noise from a hash of the id turns the weights into scores whose largest are a weighted draw without replacement.

The exact cutoff is found without sorting all rows: every partition names the median of its remaining keys, the median of
these, weighted by how many keys are left, is the pivot, and the side that cannot hold the cutoff goes, at least a quarter of the
keys in every round. Only the winners are sorted. To the driver go bucket counts, one or two keys per ``CHUNK`` rows and
round, and the last ``FINISH`` keys.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubmetrics.llm.common import ALNUM_LOWER, bound_batches, emit_rows, map_rows
from hubmetrics.plans.ordered import with_position
from hubmetrics.storage import materialize

BUCKETS = 10_000
#: Keys of which a task names a median at a time, and keys that the driver sorts in the end.
CHUNK = 1 << 20
FINISH = 4096


def run_buckets(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the bucket of each of its runs of one, two and three words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split()
    ones = list(map(zlib.crc32, words))
    spaced = [b" " + w for w in words[1:]]
    twos = list(map(zlib.crc32, spaced, ones))  # a checksum goes on from that of the words before
    threes = list(map(zlib.crc32, spaced[1:], twos))
    return len(words), np.array(ones + twos + threes, np.int64) % buckets


def bucket_counts(docs: DataFrame, text_column: str, buckets: int) -> np.ndarray:
    """How many runs of all texts fall into each bucket; every task adds up its own first."""
    def make():
        held = np.zeros(buckets, np.int64)

        def run(texts=None):
            if texts is None:
                there = np.flatnonzero(held)
                yield {"bucket": there, "n": held[there]}
                return
            for t in texts:
                held[:] += np.bincount(run_buckets(t, buckets)[1], minlength=buckets)

        return run

    long = T.LongType()
    rows = emit_rows(docs, [text_column], [T.StructField("bucket", long), T.StructField("n", long)], make)
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's and the source's smoothed shares, rounded down."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: str, seed: int) -> int:
    """Thousandths of a Gumbel number that depends on the id alone, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _is_before(order: list[tuple[str, bool]], pivot: dict) -> Column:
    """Whether a row comes before the pivot: columns in order, descending where told, NULL last."""
    out = F.lit(False)
    for name, falling in reversed(order):
        value = pivot[name]
        if value is None:
            out = F.col(name).isNotNull() | out
        else:
            c = F.col(name)
            out = F.coalesce((c > value) if falling else (c < value), F.lit(False)) | (c.eqNullSafe(F.lit(value)) & out)
    return out


def cutoff(rows: DataFrame, order: list[tuple[str, bool]], wanted: int) -> dict | None:
    """The key of the row at place ``wanted`` (from 1) in a total order; None if there is no such row.

    ``order`` lists columns, True for descending; NULL is last.
    """
    names = [n for n, _ in order]
    bound_batches(rows.sparkSession)
    schema = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("left", T.LongType()), *[rows.schema[n] for n in names]])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    arrow = to_arrow_schema(schema)
    by = [(n, "descending" if falling else "ascending") for n, falling in order]

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(held):
            table = pa.Table.from_batches(held)
            for side in (-1, 1):
                part = table.filter(pc.equal(table["side"], side))
                if len(part):
                    place = pc.sort_indices(part, sort_keys=by, null_placement="at_end")[len(part) // 2].as_py()
                    row = part.slice(place, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([side], pa.int32()), pa.array([len(part)], pa.int64()), *[row[n].combine_chunks() for n in names]], schema=arrow)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield from named(held)
                held, size = [], 0
        if size:
            yield from named(held)

    def less(a: dict, b: dict) -> bool:
        for n, falling in order:
            if a[n] != b[n]:
                if a[n] is None or b[n] is None:
                    return b[n] is None
                return (a[n] > b[n]) == falling
        return False

    class Key:
        def __init__(self, row):
            self.row = row

        def __lt__(self, other):
            return less(self.row, other.row)

    left, pivot, after, until = rows.select(*names), None, None, None
    while True:
        side = F.lit(1) if pivot is None else F.when(_is_before(order, pivot), -1).when(_same(names, pivot), 0).otherwise(1)
        found = left.select(side.cast("int").alias("side"), *names).where("side <> 0").mapInArrow(medians, schema).collect()
        before = sum(r["left"] for r in found if r["side"] < 0)
        if pivot is not None:
            if wanted == before + 1:
                return pivot
            first = wanted <= before
            after, until = (after, pivot) if first else (pivot, until)
            left = rows.select(*names)
            if after is not None:
                left = left.where(~_is_before(order, after) & ~_same(names, after))
            if until is not None:
                left = left.where(_is_before(order, until))
            wanted -= 0 if first else before + 1
            found = [r for r in found if (r["side"] < 0) == first]
        total = sum(r["left"] for r in found)
        if not 1 <= wanted <= total:
            return None
        if total <= FINISH:
            rest = sorted((r.asDict() for r in left.collect()), key=Key)
            return rest[wanted - 1]
        passed = 0
        for r in sorted((r.asDict() for r in found), key=Key):
            passed += r["left"]
            if 2 * passed >= total:
                pivot = {n: r[n] for n in names}
                break


def _same(names: list[str], pivot: dict) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.lit(pivot[n]))
    return out


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
    id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of each row of ``docs``; ``rank`` is NULL for rows that are not drawn.

    Of the rows with ``min_words`` words, ``percent`` per cent, rounded down, are drawn: largest scores first, then smaller ids
    (NULL last), then the order of the rows. NULL and empty texts have no runs and weight 0. The noise of a NULL id is that
    of an empty one. Repeated rows count each. An empty ``docs`` gives no rows, an empty ``target`` gains that are all
    against it. Other columns do not matter.
    """
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    gains = bucket_gains(bucket_counts(source, "_text", buckets), bucket_counts(target.select(target_text), target_text, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def make():
        gain = shared.value

        def run(keys, texts):
            out = {"n_words": [], "n_features": [], "weight": [], "score": []}
            for key, text in zip(keys, texts):
                words, found = run_buckets(text, buckets)
                weight = int(gain[found].sum())
                for name, value in zip(out, (words, len(found), weight, weight + noise(key or "", seed))):
                    out[name].append(value)
            return out

        return run

    long = T.LongType()
    keyed = source.withColumns({"_key": F.col("_id").cast("string"), "_row": F.monotonically_increasing_id()})
    scored = materialize(map_rows(
        keyed, ["_id", "_row"], ["_key", "_text"], [T.StructField(n, long) for n in ("n_words", "n_features", "weight", "score")], make), "scored")
    eligible = scored.where(F.col("n_words") >= min_words)
    order = [("score", True), ("_id", False), ("_row", False)]
    last = cutoff(eligible, order, eligible.count() * percent // 100)
    drawn = (F.col("n_words") >= min_words) & ((_is_before(order, last) | _same([n for n, _ in order], last)) if last else F.lit(False))
    winners = with_position(
        scored.where(drawn), [], [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")])
    columns = [F.col("_id").alias(id_column), "n_features", "weight", "score"]
    return winners.select(*columns, F.col("position").alias("rank")).unionByName(
        scored.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))
