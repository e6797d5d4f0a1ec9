"""Positions and neighbours against pandas, with one group that holds most rows and spreads over all slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hubmetrics.plans.ordered import latest_by_key, slice_groups, with_next, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    rows = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcdefgh"), n)), "v": rng.integers(0, 40, n).astype(float),
        "i": rng.permutation(n),
    })
    rows.loc[rows.index[:50], "k"] = None
    return rows, spark.createDataFrame(rows).repartition(4)


def test_hot_group_spreads_over_slices(skewed):
    sliced = slice_groups(skewed[1], ["k"], [F.col("v"), F.col("i")])
    assert sliced.where("k = 'hot'").select("_slice").distinct().count() > 1


def test_positions(skewed):
    rows, df = skewed
    got = with_position(df, ["k"], [F.col("v").asc(), F.col("i").asc()], ties=["v"]).toPandas().sort_values("i")
    rows = rows.sort_values("i")
    groups = rows.groupby("k", dropna=False)
    order = rows.sort_values(["v", "i"])
    position = order.groupby("k", dropna=False).cumcount().loc[rows.index] + 1
    assert got["position"].tolist() == position.tolist()
    assert got["group_size"].tolist() == groups["i"].transform("size").tolist()
    assert got["first_position"].tolist() == groups["v"].rank(method="min").astype(int).tolist()
    assert got["last_position"].tolist() == groups["v"].rank(method="max").astype(int).tolist()


def test_positions_without_group_and_descending(skewed):
    rows, df = skewed
    got = with_position(df, [], [F.col("i").desc()]).toPandas()
    assert (got["position"] == len(rows) - got["i"]).all() and (got["group_size"] == len(rows)).all()


def test_next(skewed):
    rows, df = skewed
    got = with_next(df, ["k"], ["v", "i"], F.col("i"), "n").toPandas().sort_values("i")
    order = rows.sort_values(["v", "i"])
    expected = order.groupby("k", dropna=False)["i"].shift(-1).loc[rows.sort_values("i").index]
    assert got["n"].fillna(-1).tolist() == expected.fillna(-1).tolist()


def test_latest(skewed):
    rows, df = skewed
    got = latest_by_key(df, ["k"], ["v"], F.col("i")).toPandas()
    expected = rows.sort_values("i").groupby("k", dropna=False)["v"].last()
    assert dict(zip(got["k"].fillna(""), got["v"])) == {("" if isinstance(k, float) else k or ""): v for k, v in expected.items()}
