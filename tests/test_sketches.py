"""Window quantiles from merged sketches: rank error against exact ranks, counts, and what is read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrafold.operators.sketches import RANK_ERROR, SketchIndex
from terrafold.plans.pyramid import PointIndex

N = 20_000
PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(23)
    x, y = rng.gamma(2.0, 20.0, N), rng.normal(50, 20, N)
    x[: N // 3], y[: N // 3] = 40.0, 50.0
    frame = pd.DataFrame({"id": np.arange(N), "x": x, "y": y})
    frame.loc[N - 2 :, "x"] = [np.nan, np.inf]
    return frame


WINDOWS = [
    (1, -1e9, -1e9, 1e9, 1e9), (2, 10.0, 20.0, 80.0, 90.0), (3, 40.0, 50.0, 40.0, 50.0), (4, 39.0, 0.0, 45.0, 99.0),
    (5, 500.0, 500.0, 600.0, 600.0), (6, 9.0, 9.0, 1.0, 1.0), (7, 60.0, 60.0, 61.0, 61.0),
]


@pytest.mark.parametrize("rows, nested", [(4, False), (10**9, False), (4, True)], ids=["deep", "top", "nested"])
def test_ranks_of_window_quantiles(spark, data, rows, nested):
    index = PointIndex.build(spark.createDataFrame(data), per_cell=16, **({"cell_bits": 6} if nested else {}))
    made = SketchIndex.build(index, rows_per_sketch=rows)
    assert made.base == (2 if rows == 4 else 0)
    windows = spark.createDataFrame(WINDOWS, "qid int, min_x double, min_y double, max_x double, max_y double")
    got = {r["qid"]: r for r in made.window_quantiles(windows, PROBS).collect()}
    assert set(got) == {w[0] for w in WINDOWS}
    known = data[np.isfinite(data.x)]
    for qid, a, b, c, d in WINDOWS:
        held = known[known.x.between(a, c) & known.y.between(b, d)]
        assert got[qid]["n"] == len(held)
        if not len(held):
            assert got[qid]["x_quantiles"] is None
            continue
        for axis in ("x", "y"):
            values = np.sort(held[axis].to_numpy())
            for p, v in zip(PROBS, got[qid][f"{axis}_quantiles"]):
                low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                assert low <= len(held) * (p + RANK_ERROR) + 1 and high >= len(held) * (p - RANK_ERROR) - 1


def test_a_window_of_everything_reads_no_points(spark, data):
    index = PointIndex.build(spark.createDataFrame(data), per_cell=16)
    made = SketchIndex.build(index, rows_per_sketch=1_000)
    made.index.points = made.index.points.limit(0)  # what is not read is not missed
    whole = spark.createDataFrame(WINDOWS[:1], "qid int, min_x double, min_y double, max_x double, max_y double")
    assert made.window_quantiles(whole, [0.5]).first()["n"] == N - 2


def test_no_points(spark):
    index = PointIndex.build(spark.createDataFrame([], "id bigint, x double, y double"))
    windows = spark.createDataFrame(WINDOWS[:2], "qid int, min_x double, min_y double, max_x double, max_y double")
    assert [r["n"] for r in SketchIndex.build(index).window_quantiles(windows, [0.5]).collect()] == [0, 0]
