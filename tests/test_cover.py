"""Shape covers against brute force: a table, a stream, skewed points, shapes of many edges and of none."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from terrafold.plans import cover as covers
from terrafold.plans.cover import ShapeCover
from terrafold.streaming.filters import read_point_stream, run_to_files

N = 3_000
RING = "poly_id int, ring array<struct<x double, y double>>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(17)
    x, y = rng.uniform(-5, 105, N), rng.uniform(-5, 55, N)
    x[: N // 3], y[: N // 3] = 40.0, 20.0
    frame = pd.DataFrame({"id": np.arange(N), "x": x, "y": y, "level": 7})
    frame.loc[N - 3 :, "x"] = [np.nan, np.inf, -np.inf]
    return frame


@pytest.fixture(scope="module")
def rings():
    t = np.linspace(0, 2 * np.pi, 1500, endpoint=False)
    r = 15 + 4 * np.sin(60 * t)
    return {
        0: [(10.0, 5.0), (90.0, 5.0), (90.0, 45.0), (50.0, 10.0), (10.0, 45.0)],
        1: [(40.0, 20.0), (45.0, 20.0), (45.0, 25.0), (40.0, 25.0)],
        2: [(float(60 + a), float(25 + b)) for a, b in zip(r * np.cos(t), r * np.sin(t))],
        3: [(0.0, 30.0), (100.0, 30.0), (100.0, 30.001), (0.0, 30.001)],
        4: [(7.0, 7.0)],
        5: [],
    }


def crossings(ring, xs, ys):
    odd = np.zeros(len(xs), dtype=bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            odd ^= ((y1 > ys) != (y2 > ys)) & (xs < (x2 - x1) * (ys - y1) / (y2 - y1) + x1)
    return odd & np.isfinite(xs)


def pairs(df, key):
    return sorted((r[key], r["id"]) for r in df.select(key, "id").collect())


@pytest.mark.parametrize("light", [True, False], ids=["broadcast", "dealt"])
def test_polygons(spark, data, rings, light, monkeypatch):
    if not light:
        monkeypatch.setattr(covers, "BROADCAST_ROWS", 0)
    cover = ShapeCover.of_polygons(spark.createDataFrame(list(rings.items()), RING))
    assert cover.light == light
    out = cover.join(spark.createDataFrame(data))
    assert out.columns == ["poly_id", "id", "x", "y", "level"]
    with np.errstate(invalid="ignore"):
        want = sorted((k, int(i)) for k, ring in rings.items() for i in data.id[crossings(ring, data.x.to_numpy(), data.y.to_numpy())])
    assert pairs(out, "poly_id") == want and len(want) > N // 3
    plan = plan_of(out)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # a node's edges are few, though one ring has 1,500
    most = cover.nodes.filter("NOT covered").agg(F.max(F.size("edges")).alias("m")).first()["m"]
    assert most <= covers.EDGES_PER_NODE
    assert cover.nodes.filter("covered AND size(edges) > 0").count() == 0


def test_a_shallow_cover_is_exact_too(spark, data, rings):
    table = spark.createDataFrame(list(rings.items()), RING)
    points = spark.createDataFrame(data)
    assert pairs(ShapeCover.of_polygons(table, depth=1).join(points), "poly_id") == pairs(ShapeCover.of_polygons(table).join(points), "poly_id")


def test_windows(spark, data):
    rng = np.random.default_rng(4)
    boxes = [(i, *(c - h), *(c + h)) for i, (c, h) in enumerate(zip(rng.uniform(0, 50, (40, 2)), rng.uniform(0, 9, (40, 2))))]
    boxes += [(50, 40.0, 20.0, 40.0, 20.0), (51, 40.0, 20.0, 40.0, 20.0), (52, 9.0, 9.0, 1.0, 1.0), (53, -1e6, -1e6, 1e6, 1e6), (50, 40.0, 20.0, 40.0, 20.0)]
    boxes = [(int(b[0]), *map(float, b[1:])) for b in boxes] + [(54, None, 1.0, 2.0, 3.0)]
    windows = spark.createDataFrame(boxes, "qid int, min_x double, min_y double, max_x double, max_y double")
    want = sorted({
        (b[0], int(p.id)) for b in boxes if b[1] is not None for p in data.itertuples() if b[1] <= p.x <= b[3] and b[2] <= p.y <= b[4] and np.isfinite(p.x)
    })
    assert pairs(ShapeCover.of_windows(windows).join(spark.createDataFrame(data)), "qid") == want


def test_no_shapes_and_no_points(spark, data, rings):
    points = spark.createDataFrame(data)
    assert ShapeCover.of_polygons(spark.createDataFrame([], RING)).join(points).count() == 0
    assert ShapeCover.of_polygons(spark.createDataFrame([(4, rings[4])], RING)).join(points).count() == 0
    assert ShapeCover.of_polygons(spark.createDataFrame([(0, rings[0])], RING)).join(points.limit(0)).count() == 0


def test_a_stream_gives_the_same_pairs_as_the_table(spark, data, rings, tmp_path):
    points = spark.createDataFrame(data).repartition(6)
    points.write.parquet(str(tmp_path / "in"))
    cover = ShapeCover.of_polygons(spark.createDataFrame(list(rings.items()), RING))
    stream = read_point_stream(spark, str(tmp_path / "in"), points.schema)
    out = run_to_files(stream, str(tmp_path / "out"), cover.join)
    assert pairs(out, "poly_id") == pairs(cover.join(points), "poly_id")
