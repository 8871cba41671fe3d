from __future__ import annotations

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as g


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_boxes_are_closed(spark):
    for x, y in ((0, 0), (2, 3), (0, 3), (2, 0), (1, 1)):
        assert value(spark, g.box_contains_point(0, 0, 2, 3, x, y))
    assert not value(spark, g.box_contains_point(0, 0, 2, 3, 2.0000001, 1))
    assert not value(spark, g.box_contains_point(2, 3, 0, 0, 1, 1))  # inverted
    assert value(spark, g.boxes_intersect((0, 0, 1, 1), (1, 1, 2, 2)))
    assert not value(spark, g.boxes_intersect((0, 0, 1, 1), (1.1, 0, 2, 2)))
    assert value(spark, g.box_contains_box((0, 0, 2, 2), (0, 0, 2, 2)))
    assert value(spark, g.box_area(2, 0, 0, 3)) == -6


def test_half_open_tiles_share_no_point(spark):
    hits = [value(spark, g.box_contains_point_half_open(i, 0, i + 1, 1, 1, 0.5)) for i in range(3)]
    assert hits == [False, True, False]


def test_distance_and_order(spark):
    assert value(spark, g.distance(0, 0, 3, 4)) == 5
    assert value(spark, g.length(3, 4)) == 5
    assert value(spark, g.precedes(1, 2, 1, 3)) and not value(spark, g.precedes(1, 3, 1, 3))
    assert value(spark, g.near_point(1.0, 1.0, 1.000001, 1.0))
    assert not value(spark, g.near_point(1.0, 1.0, 1.000001, 1.0, strict=True))


def test_box_distances(spark):
    box = (0, 0, 2, 2)
    assert value(spark, g.box_min_distance(box, 1, 1)) == 0
    assert value(spark, g.box_min_distance(box, 5, 6)) == 5
    assert value(spark, g.box_max_distance(box, 0, 0)) == pytest.approx(math.sqrt(8))


def test_rings_close_once(spark):
    opened, closed = ring((0, 0), (1, 0), (1, 1)), ring((0, 0), (1, 0), (1, 1), (0, 0))
    assert value(spark, F.size(g.close_ring(opened))) == 4
    assert value(spark, F.size(g.close_ring(closed))) == 4
    for r in (opened, closed):
        assert value(spark, g.ring_contains(r, 0.9, 0.5))
        assert not value(spark, g.ring_contains(r, 0.1, 0.5))


def test_concave_and_edges(spark):
    notch = ring((0, 0), (4, 0), (4, 4), (2, 2), (0, 4))
    assert value(spark, g.ring_contains(notch, 2, 1))
    assert not value(spark, g.ring_contains(notch, 2, 3))
    # half-open rule: left and bottom border in, right and top border out
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    assert value(spark, g.ring_contains(square, 0, 1)) and value(spark, g.ring_contains(square, 1, 0))
    assert not value(spark, g.ring_contains(square, 2, 1)) and not value(spark, g.ring_contains(square, 1, 2))


def test_haversine(spark):
    half = math.pi * g.EARTH_RADIUS_M
    assert value(spark, g.haversine_m(0, 0, 0, 180)) == pytest.approx(half)
    assert value(spark, g.haversine_m(90, 0, -90, 0)) == pytest.approx(half)
    assert value(spark, g.haversine_m(10, 20, 10, 20)) == 0


def test_degree_boxes():
    assert len(g.degree_boxes(0, 0, 1000)) == 1
    assert len(g.degree_boxes(0, 179.999, 1000)) == 2
    assert g.degree_boxes(89.999, 0, 1000)[0][1::2] == (-180.0, 180.0)
    assert g.degree_boxes(0, 0, -1) == []


def test_grid_index_folds_top_edge(spark):
    assert value(spark, g.grid_index(10, 0.0, 1.0, 10)) == 9
    assert value(spark, g.grid_index(10, 0.0, 1.0)) == 10
    assert value(spark, g.grid_index(5, 5.0, 0.0)) == 0  # constant axis


def test_hex_cells_tile(spark):
    for x, y in ((0.0, 0.0), (0.3, -0.7), (5.2, 9.9)):
        q, r = g.hex_cell(x, y, 1.0)
        cx, cy = g.hex_center(q, r, 1.0)
        assert value(spark, g.distance(cx, cy, x, y)) <= 1.0 + 1e-9


def test_haversine_bounds_hold_for_every_place_of_a_box(spark):
    """Boxes across the equator, at the poles and at +-180 degrees; far places are half way round the globe."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        s, n = sorted(rng.uniform(-90, 90, 2)) if i % 2 else (np.clip(lat - 1, -90, 90), np.clip(lat + 2, -90, 90))
        w, e = sorted(rng.uniform(-180, 180, 2)) if i % 3 else (170.0, 180.0)
        for la in (s, n, (s + n) / 2, rng.uniform(s, n)):
            for lo in (w, e, (w + e) / 2, rng.uniform(w, e)):
                rows.append(tuple(float(v) for v in (lat, lon, w, s, e, n, la, lo)))
    df = spark.createDataFrame(rows, "lat double, lon double, w double, s double, e double, n double, la double, lo double")
    near, far = g.haversine_bounds(("w", "s", "e", "n"), "lat", "lon")
    d = g.haversine_m("lat", "lon", "la", "lo")
    assert df.filter((d < near) | (d > far)).count() == 0
    # a box of one place has tight bounds
    one = [F.lit(v) for v in (10.0, 20.0, 10.0, 20.0)]
    low, high = g.haversine_bounds(one, F.lit(21.0), F.lit(-170.0))
    exact = value(spark, g.haversine_m(F.lit(21.0), F.lit(-170.0), F.lit(20.0), F.lit(10.0)))
    assert value(spark, low) == pytest.approx(exact, abs=0.1) == pytest.approx(value(spark, high), abs=0.1)
