"""Line simplification (Douglas-Peucker) of shapes of any size, in three passes.

1. Points are sorted over the cluster by shape and number. Each task writes its points to a file and returns one row for
   every slice, a run of at most ``SLICE_POINTS`` points of one shape: where it stands and the box around it.
2. Spans that reach over several slices are cut, shape by shape, from these rows alone: the corners of a box bound the
   distance of its slice's points from a chord, so only slices whose bound is not below the best distance found are read.
3. What is left lies within slices, which are all independent of each other.

However the cuts follow one another, there are no further passes. The second pass holds one row for every slice of a shape,
the points at which it cut, and a few slices; a shape of a single slice is not read in it. Its work grows with the number of
cuts times that of the slices, and only spans over a border between slices are cut there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubmetrics import rules
from hubmetrics.operators.tracks import SHAPE, as_pairs
from hubmetrics.storage import materialize, open_store, scratch_path

SLICE_POINTS = 10_000
#: Points that the last pass reads and works on at a time.
BLOCK_POINTS = 50_000
#: Slices of a shape that the second pass keeps in memory.
HELD_SLICES = 16
_POINT = np.dtype([("seq", "<i8"), ("lon", "<f8"), ("lat", "<f8")])
_BOX = ["west", "south", "east", "north"]
_SLICE = ("route_id string, shape_id string, first_seq long, file string, start long, n int, "
          "west double, south double, east double, north double")
_CUT = "route_id string, shape_id string, file string, start long, n int, kept array<int>, has_next boolean, next_seq long, next_lon double, next_lat double"
_PAIR = "route_id string, shape_id string, seq long, lon double, lat double, next_seq long, next_lon double, next_lat double"


def simplified_pairs(
    points: DataFrame, tolerance: float = rules.SIMPLIFY_TOLERANCE, slice_points: int = SLICE_POINTS
) -> DataFrame:
    """Simplify each shape and return the pairs of consecutive kept points; of equally far points the first one counts.

    ``seq`` numbers the points of a shape; a number that occurs twice counts once. Points without a shape or a finite place
    are left out, and shapes of one point have no pairs.
    """
    spark = points.sparkSession
    finite = [F.abs(F.col(c)) < F.lit(float("inf")) for c in ("lon", "lat")]
    unique = points.where(finite[0] & finite[1]).dropna(subset=SHAPE).groupBy(
        *[F.col(c).cast("string").alias(c) for c in SHAPE], F.col("seq").cast("bigint").alias("seq")
    ).agg(F.min(F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))).alias("_p"))
    in_order = unique.select(*SHAPE, "seq", "_p.lon", "_p.lat").repartitionByRange(*SHAPE, "seq").sortWithinPartitions(*SHAPE, "seq")
    folder = scratch_path(spark, "slices")
    # The written list fixes which attempt's files count.
    slices = materialize(in_order.mapInPandas(lambda batches: _write_slices(batches, folder, slice_points), _SLICE), "slices")
    # The rows are few and short, so adaptive execution would join their partitions; a stated number is left alone.
    points_in_all = slices.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points_in_all // SLICE_POINTS)))
    by_shape = slices.repartition(tasks, *SHAPE).sortWithinPartitions(*SHAPE, "first_seq")
    cut = by_shape.mapInPandas(lambda batches: _cut_shapes(batches, tolerance), _CUT)
    dealt = cut.repartition(tasks, F.col("file"), F.floor(F.col("start") / BLOCK_POINTS)).sortWithinPartitions("file", "start")
    return as_pairs(dealt.mapInPandas(lambda batches: _simplify_slices(batches, tolerance), _PAIR))


def simplified_points(pairs: DataFrame) -> DataFrame:
    """The kept points of each shape, from the pairs of consecutive kept points."""
    ends = F.inline(F.array(
        F.struct(F.col("seq"), F.col("p1").alias("_p")), F.struct(F.col("next_seq").alias("seq"), F.col("p2").alias("_p"))
    ))
    return pairs.select(*SHAPE, ends).distinct().select(*SHAPE, "seq", "_p.lon", "_p.lat")


def _shape_starts(rows: pd.DataFrame) -> np.ndarray:
    """Numbers of the rows that belong to another shape than the row before."""
    keys = rows[SHAPE]
    return np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())


def _read(file: str, start: int, n: int) -> np.ndarray:
    store, path = open_store(file)
    with store.open_input_file(path) as source:
        source.seek(start * _POINT.itemsize)
        return np.frombuffer(source.read(n * _POINT.itemsize), _POINT)


def _write_slices(batches: Iterator[pd.DataFrame], folder: str, slice_points: int) -> Iterator[pd.DataFrame]:
    """Write the points of a task to one file; a slice ends with its shape, its batch or ``slice_points``."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    written = 0
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        for rows in batches:
            if rows.empty:
                continue
            records = np.empty(len(rows), _POINT)
            for column in _POINT.names:
                records[column] = rows[column].to_numpy()
            out.write(records.tobytes())
            starts = _shape_starts(rows)
            size = np.diff(np.append(starts, len(rows)))
            parts = -(-size // slice_points)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(starts, parts) + nth * slice_points
            lon, lat = records["lon"], records["lat"]
            yield pd.DataFrame({
                "route_id": rows["route_id"].to_numpy()[at], "shape_id": rows["shape_id"].to_numpy()[at],
                "first_seq": records["seq"][at], "file": f"{folder}/{name}", "start": written + at,
                "n": np.diff(np.append(at, len(rows))).astype(np.int32),
                "west": np.minimum.reduceat(lon, at), "south": np.minimum.reduceat(lat, at),
                "east": np.maximum.reduceat(lon, at), "north": np.maximum.reduceat(lat, at),
            })
            written += len(rows)


def _distance(x, y, ax, ay, bx, by):
    """Distance of points from the line through a and b, from a itself if both are the same."""
    dx, dy = bx - ax, by - ay
    area = np.abs(dy * x - dx * y + bx * ay - by * ax)
    ex, ey = x - ax, y - ay
    point_like = (dx == 0) & (dy == 0)
    return np.where(point_like, np.sqrt(ex * ex + ey * ey), area / np.where(point_like, 1.0, np.sqrt(dy * dy + dx * dx)))


def _bounds(box: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
    """What no distance of a point in each box exceeds, rounding of the distance included."""
    west, south, east, north = box.T
    corners = [_distance(x, y, ax, ay, bx, by) for x in (west, east) for y in (south, north)]
    largest = np.maximum.reduce(corners)
    dx, dy = abs(bx - ax), abs(by - ay)
    if dx == 0 and dy == 0:
        terms = largest
    else:
        far_x, far_y = np.maximum(abs(west), abs(east)), np.maximum(abs(south), abs(north))
        terms = (dy * far_x + dx * far_y + abs(bx * ay) + abs(by * ax)) / np.sqrt(dy * dy + dx * dx)
    return largest + 16 * np.finfo(float).eps * terms


def _wide_cuts(size: np.ndarray, box: np.ndarray, read, tolerance: float) -> dict[int, tuple]:
    """Points of one shape that the spans over several slices are cut at, and its ends: (seq, lon, lat) by place."""
    begin = np.cumsum(size) - size
    total = int(size.sum())

    def slice_of(at: int) -> int:
        return int(np.searchsorted(begin, at, "right")) - 1

    def point(at: int) -> tuple:
        s = slice_of(at)
        return read(s)[at - int(begin[s])].item()

    kept = {at: point(at) for at in (0, total - 1)}
    spans = [(0, total - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2 or slice_of(a) == slice_of(b):
            continue
        chord = (*kept[a][1:], *kept[b][1:])
        first, last = slice_of(a + 1), slice_of(b - 1)
        bound = _bounds(box[first: last + 1], *chord)
        best, far = tolerance, None
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < best:
                break
            s = first + int(k)
            low, high = max(a + 1 - int(begin[s]), 0), min(b - int(begin[s]), int(size[s]))
            inside = read(s)[low:high]
            distance = _distance(inside["lon"], inside["lat"], *chord)
            m = int(distance.argmax())
            at = int(begin[s]) + low + m
            if distance[m] > best or (far is not None and distance[m] == best and at < far):
                best, far = distance[m], at
        if far is not None:
            kept[far] = point(far)
            spans += [(a, far), (far, b)]
    return kept


def _cut_shapes(batches: Iterator[pd.DataFrame], tolerance: float) -> Iterator[pd.DataFrame]:
    """Slices with kept points, these as places in the slice, and the first kept point after them. A shape comes whole."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        starts = _shape_starts(rows)
        # The last shape may go on in the next batch.
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield _cut_rows(rows.iloc[:last], tolerance)
        rest = rows.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield _cut_rows(rest, tolerance)


def _cut_rows(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    starts = _shape_starts(rows)
    files, places, sizes, boxes = rows["file"].to_numpy(), rows["start"].to_numpy(), rows["n"].to_numpy(), rows[_BOX].to_numpy()
    out: list[tuple] = []
    for low, high in zip(starts, np.append(starts[1:], len(rows))):
        if high - low == 1:
            out.append((low, [0, sizes[low] - 1] if sizes[low] > 1 else [0], False, 0, 0.0, 0.0))
            continue
        size = sizes[low:high].astype(np.int64)

        @lru_cache(HELD_SLICES)
        def read(s, low=low):
            return _read(files[low + s], int(places[low + s]), int(sizes[low + s]))

        kept = _wide_cuts(size, boxes[low:high], read, tolerance)
        at = np.array(sorted(kept))
        begin = np.cumsum(size) - size
        owner = np.searchsorted(begin, at, "right") - 1
        with_kept, first = np.unique(owner, return_index=True)
        ends = np.append(first[1:], len(at))
        for s, one, end in zip(with_kept, first, ends):
            following = (True, *kept[int(at[end])]) if end < len(at) else (False, 0, 0.0, 0.0)
            out.append((low + s, (at[one:end] - begin[s]).tolist(), *following))
    number, *columns = zip(*out)
    cut = rows.iloc[list(number)][["route_id", "shape_id", "file", "start", "n"]].reset_index(drop=True)
    for name, values in zip(("kept", "has_next", "next_seq", "next_lon", "next_lat"), columns):
        cut[name] = list(values)
    return cut


def _simplify_slices(batches: Iterator[pd.DataFrame], tolerance: float) -> Iterator[pd.DataFrame]:
    """Pairs of consecutive kept points, for slices in order of file and place."""
    for rows in batches:
        for _, block in rows.groupby([rows["file"], rows["start"] // BLOCK_POINTS], sort=False):
            yield _simplify_block(block.reset_index(drop=True), tolerance)


def _simplify_block(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    start = rows["start"].to_numpy()
    records = _read(rows["file"][0], int(start[0]), int(start[-1] - start[0] + rows["n"].iloc[-1]))
    lon, lat = (np.ascontiguousarray(records[c]) for c in ("lon", "lat"))
    begin = start - start[0]
    counts = rows["kept"].map(len).to_numpy()
    known = np.concatenate(rows["kept"].to_list()).astype(np.int64) + np.repeat(begin, counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = owner[:-1] == owner[1:]
    kept = np.union1d(known, _kept(lon, lat, known[:-1][inside], known[1:][inside], tolerance))
    owner = np.searchsorted(begin, kept, "right") - 1
    last = np.append(owner[:-1] != owner[1:], True)
    following = np.minimum(np.arange(1, len(kept) + 1), len(kept) - 1)
    has_next = ~last | rows["has_next"].to_numpy()[owner]
    pairs = {c: rows[c].to_numpy()[owner] for c in SHAPE}
    for c in _POINT.names:
        mine = records[c][kept]
        pairs[c] = mine
        pairs[f"next_{c}"] = np.where(last, rows[f"next_{c}"].to_numpy()[owner], mine[following])
    return pd.DataFrame(pairs)[has_next]


def _kept(x: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that are kept in many spans at once, the ends of the spans included.

    ``first`` and ``last`` are the places of each span's ends. In every round all open spans are measured together and
    cut at the first of their farthest points.
    """
    keep = np.zeros(len(x), dtype=bool)
    keep[first] = keep[last] = True
    a, b = first, last
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if len(a) == 0:
            return np.flatnonzero(keep)
        inner = b - a - 1
        begin = np.cumsum(inner) - inner
        span = np.repeat(np.arange(len(a)), inner)
        at = np.arange(inner.sum()) + np.repeat(a + 1 - begin, inner)
        distance = _distance(x[at], y[at], x[a][span], y[a][span], x[b][span], y[b][span])
        largest = np.maximum.reduceat(distance, begin)
        reached = np.flatnonzero(distance == largest[span])
        far = at[reached[np.unique(span[reached], return_index=True)[1]]]
        cut = largest > tolerance
        a, b, far = a[cut], b[cut], far[cut]
        keep[far] = True
        a, b = np.concatenate([a, far]), np.concatenate([far, b])
