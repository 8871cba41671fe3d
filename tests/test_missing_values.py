"""NaN and null coordinates and null groups."""

from __future__ import annotations

import math

from terrafold.operators import cells, joins, lookup, models, prepare
from terrafold.plans.extent import Extent
from terrafold.plans.ordering import exact_quantiles, number_rows
from terrafold.plans.pyramid import PointIndex


def points(spark):
    rows = [(i, float(i), float(i % 7), None if i % 4 == 0 else "g") for i in range(100)]
    rows += [(100, math.nan, 1.0, "g"), (101, 2.0, math.nan, None), (102, None, None, None)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, g string")


def test_extent_takes_nan_as_missing(spark):
    e = Extent.of(points(spark))
    assert (e.n, e.box) == (103, (0.0, 0.0, 99.0, 6.0))
    scaled = {r["id"]: r["x"] for r in prepare.minmax_normalize(points(spark)).collect()}
    assert scaled[99] == 1.0 and scaled[33] == 33 / 99 and math.isnan(scaled[100])


def test_null_groups_stay(spark):
    known = points(spark).filter("id < 100")
    got = number_rows(known, ["id"], by=["g"]).collect()
    assert len(got) == 100 and sorted(r["row_no"] for r in got if r["g"] is None) == list(range(25))
    q = {r["g"]: r["value"] for r in exact_quantiles(known, "x", [0.5], ["g"]).collect()}
    assert q[None] == 48.0 and len(q) == 2
    cdf = models.cdf(known, key="x", cell="g").collect()
    assert len(cdf) == 100 and max(r["rank"] for r in cdf if r["g"] is None) == 24


def test_batch_existence_does_not_multiply(spark):
    many = spark.createDataFrame([(1.0, 2.0)] * 300 + [(3.0, 4.0)], "x double, y double")
    probes = spark.createDataFrame([(i, 1.0, 2.0) for i in range(300)] + [(900, 3.0, 4.0), (901, 9.0, 9.0)], "qid bigint, qx double, qy double")
    got = {r["qid"]: r["found"] for r in lookup.points_exist(many, probes).collect()}
    assert len(got) == 302 and got[900] and not got[901] and got[5]


def test_infinite_coordinates_are_missing_everywhere(spark):
    rows = [(i, float(i % 50), float(i % 37), "g") for i in range(500)]
    wild = rows + [(500 + k, v, 1.0, "g") for k, v in enumerate((math.inf, -math.inf, math.nan, None))]
    schema = "id bigint, x double, y double, g string"
    clean, odd = spark.createDataFrame(rows, schema), spark.createDataFrame(wild, schema)
    for make in (
        lambda p: cells.grid_cells(p, 8), lambda p: cells.quad_tree_cells(p, 16), lambda p: cells.kd_tree_cells(p, 8, exact=True),
        lambda p: cells.quantile_grid(p, 16), lambda p: cells.assign_to_boxes(p, cells.sort_tile_boxes(p, 9)),
    ):
        want = {r["id"]: r["cell_id"] for r in make(clean).collect()}
        got = {r["id"]: r["cell_id"] for r in make(odd).collect()}
        assert {i: c for i, c in got.items() if i < 500} == want and len(got) == 504
        assert all(c in (None, -1) for i, c in got.items() if i >= 500)
    index = PointIndex.build(odd)
    everything = spark.createDataFrame([(1, -1e300, -1e300, 1e300, 1e300)], "qid int, min_x double, min_y double, max_x double, max_y double")
    assert joins.window_counts(index, everything).first()["n"] == 500
    assert joins.window_join(index, everything).count() == 500
