"""FeatureCollection files of any size, read and written by many tasks.

A file is cut into ranges of bytes. What stands at the start of a range, inside a text or not and how many brackets deep,
depends on all that comes before, so a first pass notes for both possibilities what a range does to them: quotes, change of
depth, and the brackets that it leaves open. These notes, one row per range, are added up by running sums over a file's
ranges. In the second pass every task knows its start and cuts out the features that begin in its range; one that goes on
beyond is read to its end. Files are opened through Arrow, so their path must be local or on HDFS, S3 or GCS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hubmetrics.storage import materialize, open_store

#: Bytes of a range, and about how many a task reads.
RANGE_BYTES = 8 << 20
TASK_BYTES = 64 << 20

_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _LIST = 34, 92, (123, 91), (125, 93), 91
_KEY = re.compile(rb'"features"\s*:\s*\Z')
_NOTE = ("path string, start long, length long, quotes long, "
         "out_depth long, out_level array<long>, out_features array<boolean>, "
         "in_depth long, in_level array<long>, in_features array<boolean>")


class _Bytes:
    """Bytes of an open file by place."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def get(self, start: int, end: int) -> bytes:
        start, end = max(start, 0), min(end, self.size)
        self.file.seek(start)
        return self.file.read(max(end - start, 0))

    def before(self, place: int, inside) -> bytes:
        """Bytes before ``place`` back to the first that ``inside`` does not hold, that one included."""
        step = 64
        while True:
            got = self.get(place - step, place)
            if len(got.rstrip(inside)) > 0 or step >= place:
                return got
            step *= 2

    def is_features(self, place: int) -> bool:
        """Whether the list that opens at ``place`` is the value of the key "features"."""
        blanks = b" \t\r\n"
        colon = place - 1 - (len(b := self.before(place, blanks)) - len(b.rstrip(blanks)))
        if self.get(colon, colon + 1) != b":":
            return False
        quote = colon - (len(b := self.before(colon, blanks)) - len(b.rstrip(blanks)))
        found = self.get(quote - 11, quote)
        # A longer key that ends like this one has an escaped quote there.
        return _KEY.search(found + b":") is not None and not found.startswith(b"\\")

    def escaped(self, place: int) -> bool:
        """Whether an odd number of backslashes stands right before ``place``."""
        got = self.before(place, b"\\")
        return (len(got) - len(got.rstrip(b"\\"))) % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that begin or end a text."""
    found = np.flatnonzero(data == _QUOTE)
    slashes = np.flatnonzero(data == _BACKSLASH)
    if escaped:
        slashes = np.concatenate([[-1], slashes])
    if not len(slashes):
        return found
    first = np.flatnonzero(np.diff(slashes, prepend=-3) != 1)
    length = np.diff(np.append(first, len(slashes)))
    return np.setdiff1d(found, (slashes[first] + length)[length % 2 == 1], assume_unique=True)


def _brackets(data: np.ndarray, quotes: np.ndarray, in_text: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside texts, and the depth after each, counted from 0 at the start."""
    places = np.flatnonzero((data == _OPEN[0]) | (data == _OPEN[1]) | (data == _CLOSE[0]) | (data == _CLOSE[1]))
    places = places[(np.searchsorted(quotes, places) + in_text) % 2 == 0]
    kind = data[places]
    return places, np.cumsum(np.where((kind == _OPEN[0]) | (kind == _OPEN[1]), 1, -1), dtype=np.int64)


def _left_open(data: np.ndarray, places: np.ndarray, depth: np.ndarray, source: _Bytes, start: int) -> tuple[list, list]:
    """Depths before the brackets that stay open at the end of a range, and whether they open a list of features."""
    if not len(places):
        return [], []
    lowest = np.minimum.accumulate(depth[::-1])[::-1]
    opens = (data[places] == _OPEN[0]) | (data[places] == _OPEN[1])
    stay = np.flatnonzero(opens & (lowest >= depth))
    return (depth[stay] - 1).tolist(), [
        bool(data[p] == _LIST and source.is_features(start + int(p))) for p in places[stay]]


def _note_rows(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, start, length in batch[["path", "start", "length"]].itertuples(index=False):
            store, place = open_store(path)
            with store.open_input_file(place) as file:
                source = _Bytes(file, length)
                data = np.frombuffer(source.get(start, start + size), np.uint8)
                quotes = _quotes(data, source.escaped(start))
                row = [path, start, length, len(quotes)]
                for in_text in (False, True):
                    places, depth = _brackets(data, quotes, in_text)
                    row += [int(depth[-1]) if len(depth) else 0, *_left_open(data, places, depth, source, start)]
                rows.append(row)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _NOTE.split(", ")])


def _features(source: _Bytes, start: int, size: int, in_text: bool, depth: int, within: bool) -> Iterator[str]:
    """Texts of the features that begin in a range."""
    data = np.frombuffer(source.get(start, start + size), np.uint8)
    places, after = _brackets(data, _quotes(data, source.escaped(start)), in_text)
    after = after + depth
    kind = data[places]
    holder = np.flatnonzero((after == 2) & ((kind == _OPEN[0]) | (kind == _OPEN[1])))
    told = np.array([within, *(bool(kind[h] == _LIST and source.is_features(start + int(places[h]))) for h in holder)])
    begins = np.flatnonzero((kind == _OPEN[0]) & (after == 3))
    begins = begins[told[np.searchsorted(holder, begins)]]
    ends = np.flatnonzero((kind == _CLOSE[0]) & (after == 2))
    closed = np.searchsorted(ends, begins)
    for b, e in zip(begins, closed):
        at = int(places[b])
        if e < len(ends):
            yield data[at: int(places[ends[e]]) + 1].tobytes().decode("utf-8", "replace")
        else:
            yield _to_its_end(source, start + at, size).decode("utf-8", "replace")


def _to_its_end(source: _Bytes, at: int, step: int) -> bytes:
    """The object that begins at ``at``, read in growing pieces until its bracket closes or the file ends."""
    step = max(step, 1024)
    while True:
        raw = source.get(at, at + step)
        data = np.frombuffer(raw, np.uint8)
        places, depth = _brackets(data, _quotes(data, False), False)
        closed = np.flatnonzero(depth == 0)
        if len(closed):
            return raw[: int(places[closed[0]]) + 1]
        if at + step >= source.size:
            return raw
        step *= 2


def read_collections(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The features of all FeatureCollection files at ``path`` as JSON text in the column ``value``.

    Only objects in the list under the top-level key "features" are features, wherever that key stands. Texts may hold
    brackets, quotes and escapes. An empty file or list gives no rows; a feature that the file's end cuts off comes as it
    stands. Files are UTF-8 and hold one collection each.
    """
    # Only path and length are read here, not the content.
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    size = F.lit(range_bytes).cast("bigint")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, size)).alias("start"))
    known = cut.agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.least(F.col("length") - F.col("start"), size)).alias("bytes")).first()
    tasks = max(1, min(known["ranges"], max(-(-(known["bytes"] or 0) // TASK_BYTES), spark.sparkContext.defaultParallelism)))
    notes = materialize(cut.repartition(tasks).mapInPandas(lambda batches: _note_rows(batches, range_bytes), _NOTE), "ranges")
    # One row per range of a file.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    in_text = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    told = notes.withColumn("in_text", in_text)
    for part in ("depth", "level", "features"):
        told = told.withColumn(part, F.when(F.col("in_text"), F.col(f"in_{part}")).otherwise(F.col(f"out_{part}")))
    deep = told.withColumn("at", F.coalesce(F.sum("depth").over(before), F.lit(0)))
    # The bracket that a range leaves open at depth 1, if any: the list or object that what follows stands in.
    opened = F.get("features", F.array_position("level", 1 - F.col("at")).cast("int") - 1)
    placed = deep.withColumn("opened", opened).withColumn("within", F.coalesce(F.last("opened", ignorenulls=True).over(before), F.lit(False)))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, length, inside, at, within in batch.itertuples(index=False):
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    found = []
                    for text in _features(_Bytes(file, length), start, range_bytes, inside, at, within and at >= 2):
                        found.append(text)
                        if len(found) == 1000:
                            yield pd.DataFrame({"value": found})
                            found = []
                    yield pd.DataFrame({"value": pd.Series(found, dtype=object)})

    ready = placed.select("path", "start", "length", "in_text", "at", "within").repartition(tasks)
    return ready.mapInPandas(cut_out, "value string")


def write_collections(features: DataFrame, path: str) -> None:
    """Write features (JSON texts in ``value``) as FeatureCollection files, one file per task, overwriting the folder.

    NULL texts are left out; a task without features writes an empty collection.
    """
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['{"type":"FeatureCollection","features":[']})
        first = True
        for batch in batches:
            texts = batch["value"].dropna().tolist()
            if texts:
                yield pd.DataFrame({"value": [t if first and k == 0 else "," + t for k, t in enumerate(texts)]})
                first = False
        yield pd.DataFrame({"value": ["]}"]})

    features.select("value").mapInPandas(lines, "value string").write.option("maxRecordsPerFile", 0).mode("overwrite").text(path)
