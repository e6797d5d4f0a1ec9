"""FeatureCollections read by ranges of bytes, against a JSON reader."""

import json
import random

import pytest

from hubmetrics.sources import collections as C
from hubmetrics.sources import features as E

NASTY = ['"', "\\", '\\"', "{", "}", "[", "]", '"features": [{', "\\\\", "é", "\U0001f600", "\n", " ", "x" * 40, "]}", '\\"features\\":[']


def nasty(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.3:
        return {rng.choice(["features", "type", "a\\", 'q"features']) + str(rng.randrange(2)) * rng.randrange(2): nasty(rng, depth + 1) for _ in range(3)}
    if depth < 3 and kind < 0.5:
        return [nasty(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -2.5, None, True, "".join(rng.choices(NASTY, k=rng.randrange(6)))])


def collection(rng, n):
    members = [("type", "FeatureCollection"), ("bbox", [1, [2, {"features": [{"no": 1}]}]]), ("crs", {"features": [{"no": 2}], "p": {"x": "}"}}),
               ("xfeatures", [{"no": 3}]), ('q"features', [{"no": 4}]), ("features", [{"type": "Feature", "properties": nasty(rng), "k": k} for k in range(n)]),
               ("later", [{"no": 5}, [{"no": 6}]])]
    rng.shuffle(members)
    return dict(members)


@pytest.mark.parametrize("size", [1, 13, 100, 5000])
def test_ranges_of_any_size_find_all_features(spark, tmp_path, size):
    rng = random.Random(size)
    expected = []
    for k, n in enumerate([0, 1, 3, 12] if size == 1 else [0, 1, 5, 40]):
        whole = collection(rng, n)
        expected += whole["features"]
        text = json.dumps(whole, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([None, (",", ":"), (" , ", " : ")]))
        (tmp_path / f"{k} %41.json").write_text("  " * k + text + "\n" * k, encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    found = [r.value for r in C.read_collections(spark, str(tmp_path), size).collect()]
    assert sorted(json.dumps(json.loads(v), sort_keys=True) for v in found) == sorted(json.dumps(f, sort_keys=True) for f in expected)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "all.json").write_text(json.dumps({"features": [{"properties": {"segment_id": str(k), "corridor": "c" * 50}} for k in range(300)]}))
    read = C.read_collections(spark, str(tmp_path / "all.json"), 1000)
    assert read.rdd.getNumPartitions() >= 4
    assert sum(n > 0 for n in read.rdd.glom().map(len).collect()) >= 3
    assert read.count() == 300


def test_cut_off_and_unreadable_features(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"features":[{"properties":{"segment_id":"a"}},{"properties":7},{"properties":{"segment_id":"b"')
    read = E.read_segment_features(spark, str(tmp_path / "cut.json"), per_line=False)
    assert [r.segment_id for r in read.collect()] in (["a", None, None], ["a", None, "b"])
    (tmp_path / "other.json").write_text('{"geometries":[{"a":1}]}')
    assert C.read_collections(spark, str(tmp_path / "other.json")).count() == 0


def test_written_collections_are_whole_files(spark, tmp_path):
    rows = [(json.dumps({"type": "Feature", "properties": {"segment_id": f'"{k}\\'}}),) for k in range(50)] + [(None,)]
    features = spark.createDataFrame(rows, "value string").repartition(3)
    C.write_collections(features, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    held = [f for file in files for f in json.loads(file.read_text())["features"]]
    assert len(files) >= 3 and len(held) == 50
    assert {r.value for r in C.read_collections(spark, str(tmp_path / "out"), 64).collect()} == {r[0] for r in rows if r[0]}
