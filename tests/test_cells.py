from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.functions import codes
from terrafold.operators import cells, diagnostics, quadtable
from terrafold.plans.extent import Extent

N = 2_000
SCHEMA = "id bigint, x double, y double"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.where(rng.random(N) < 0.34, 3.0, rng.uniform(0, 16, N))
    y = np.where(x == 3.0, 4.0, rng.uniform(0, 16, N))
    return pd.DataFrame({"id": np.arange(N), "x": x, "y": y})


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame(data).repartition(4)


METHODS = {
    "fixed": lambda p: cells.fixed_stripes(p),
    "adaptive": lambda p: cells.adaptive_stripes(p),
    "grid": lambda p: cells.grid_cells(p, 7, 3),
    "quantile": lambda p: cells.quantile_grid(p, 25),
    "quad": lambda p: cells.quad_tree_cells(p, 20),
    "kd": lambda p: cells.kd_tree_cells(p, 16),
    "kd exact": lambda p: cells.kd_tree_cells(p, 8, exact=True),
    "tiles": lambda p: cells.sort_tiles(p, 4, 3),
    "boxes": lambda p: cells.assign_to_boxes(p, cells.sort_tile_boxes(p, 12)),
}


@pytest.mark.parametrize("name", list(METHODS))
def test_nothing_is_lost_or_repeated(points, name):
    out = METHODS[name](points)
    assert diagnostics.loss_check(points, out).first()["n_lost"] == 0
    assert out.select("id").distinct().count() == N
    assert set(points.columns) | {"cell_id"} <= set(out.columns)


@pytest.mark.parametrize("name", [n for n in METHODS if n not in ("boxes", "tiles")])
def test_empty_input(spark, name):
    out = METHODS[name](spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "cell_id" in out.columns


def test_constant_axis(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(20)], SCHEMA)
    assert {r["stripe"] for r in cells.fixed_stripes(df).collect()} == {0}
    assert {r["cell_id"] for r in cells.grid_cells(df, 2, 2).collect()} == {0, 2}


def test_quad_tree_matches_recursion(spark, points, data):
    tree = cells.QuadTree.fit(points, 20, depth=5)
    cap = N // 20
    e = Extent.of(points)
    leaves = []

    def grow(x0, y0, w, h, level, code):
        held = data[(data.x >= x0) & (data.x < x0 + w) & (data.y >= y0) & (data.y < y0 + h)]
        if len(held) <= cap or level == 5:
            leaves.append((code, len(held)))
            return
        for digit, (dx, dy) in enumerate(((0, 1), (1, 1), (0, 0), (1, 0))):
            grow(x0 + dx * w / 2, y0 + dy * h / 2, w / 2, h / 2, level + 1, code + str(digit))

    grow(e.min_x, e.min_y, e.width + codes.EDGE_PAD, e.height + codes.EDGE_PAD, 0, "")
    got = tree.zones(spark).orderBy("zone_id").collect()
    assert [(r["code"], r["n"]) for r in got] == leaves
    sizes = {r["cell_id"]: r["n"] for r in diagnostics.cell_counts(tree.assign(points)).collect()}
    assert sizes == {i: n for i, (_, n) in enumerate(leaves) if n}
    outside = spark.createDataFrame([(1, -5.0, 0.0)], SCHEMA)
    assert tree.assign(outside).first()["cell_id"] is None


def test_zone_boxes_hold_their_points(spark, points):
    tree = cells.QuadTree.fit(points, 20, depth=5)
    kd = cells.KdTree.fit(points, 16)
    for assigned, zones in ((tree.assign(points), tree.zones(spark)), (kd.assign(points), kd.zones(spark, Extent.of(points)))):
        joined = assigned.join(zones, assigned.cell_id == zones.zone_id)
        inside = (F.col("x") >= F.col("min_x") - 1e-9) & (F.col("x") < F.col("max_x") + 1e-9) & (
            F.col("y") >= F.col("min_y") - 1e-9) & (F.col("y") < F.col("max_y") + 1e-9)
        assert joined.filter(inside).count() == N


def test_window_zones(spark, points):
    tree = cells.QuadTree.fit(points, 20, depth=5)
    assert tree.zones_for_window(spark, (-1.0, -1.0, 99.0, 99.0)).count() == len(tree.leaves)
    assert tree.zones_for_window(spark, (50.0, 50.0, 60.0, 60.0)).count() == 0


def test_depth_is_checked(points):
    for depth in (0, -1, 27):
        with pytest.raises(ValueError):
            cells.quad_codes(points, depth)


def test_rollup_levels_add_up(points):
    sums = cells.quad_rollup(points, 4).groupBy("level").agg(F.sum("n").alias("n")).collect()
    assert {(r["level"], r["n"]) for r in sums} == {(i, N) for i in range(1, 5)}


def test_tiles_are_even(points):
    sizes = [r["n"] for r in diagnostics.cell_counts(cells.sort_tiles(points, 4, 3)).collect()]
    assert len(sizes) == 12 and max(sizes) - min(sizes) <= 1


def test_boxes_pick_the_first_and_mark_leftovers(spark):
    boxes = spark.createDataFrame(
        [(0, 0.0, 0.0, 2.0, 2.0), (1, 2.0, 0.0, 4.0, 2.0), (2, 0.0, 0.0, 4.0, 4.0)],
        "box_id int, min_x double, min_y double, max_x double, max_y double",
    )
    pts = spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, 1.0), (3, 3.0, 3.0), (4, 9.0, 9.0)], SCHEMA)
    got = {r["id"]: r["cell_id"] for r in cells.assign_to_boxes(pts, boxes).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: -1}


def test_balance_counts_empty_cells(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 2.0, 2.0, 0), (3, 1.0, 1.0, 3)], SCHEMA + ", cell_id int")
    table = diagnostics.cells_table(df)
    b = diagnostics.partition_balance(table, 4).first()
    assert (b["min_n"], b["max_n"], b["avg_n"], b["empty"], b["max_area"]) == (0, 2, 0.75, 2, 4.0)
    h = {r["bucket"]: r["cells"] for r in diagnostics.size_histogram(table, 4).collect()}
    assert h == {"0": 2, "1-100": 2, "101-1000": 0, "1001-10000": 0, ">10000": 0}
    assert diagnostics.small_cell_ratio(table).first()["ratio"] == 1.0
    assert diagnostics.small_cell_ratio(table.filter("n > 99")).first()["ratio"] == 0.0
    flags = {r["cell_id"]: r["single_location"] for r in table.collect()}
    assert flags == {0: False, 3: True}
    r = diagnostics.report(df, df, "demo", 4).first()
    assert r["n_lost"] == 0 and r["histogram"]["1-100"] == 2 and r["empty"] == 2


def test_boxes_cut_from_a_sample_leave_no_point_outside(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE_ROWS", 500)
    rows = [(i, float(i * 7919 % 10_007), float(i * 104_729 % 3_001)) for i in range(6_000)] + [(6_000, None, 1.0), (6_001, float("nan"), 1.0)]
    points = spark.createDataFrame(rows, "id int, x double, y double")
    boxes = cells.sort_tile_boxes(points, cells=25)
    assert boxes.agg(F.sum("n"), F.count("box_id")).first() == (6_000, 25)
    lost = cells.assign_to_boxes(points, boxes).filter("cell_id = -1")
    assert sorted(r["id"] for r in lost.collect()) == [6_000, 6_001]


@pytest.mark.parametrize("bucket, light", [(4_096, True), (8, True), (8, False)])
def test_leaves_as_a_table_are_the_same_tree(spark, points, monkeypatch, bucket, light):
    monkeypatch.setattr(quadtable, "LEAVES_PER_BUCKET", bucket)
    if not light:
        monkeypatch.setattr(quadtable, "BROADCAST_CUTS", 0)
    tree, table = cells.QuadTree.fit(points, 20, depth=6), quadtable.QuadTable.fit(points, 20, depth=6)
    columns = ["zone_id", "code", "level", "n", "min_x", "min_y", "max_x", "max_y"]
    assert table.zones().select(columns).orderBy("zone_id").collect() == tree.zones(spark).select(columns).orderBy("zone_id").collect()
    odd = points.unionByName(spark.createDataFrame([(-1, -5.0, 0.0), (-2, None, 1.0), (-3, float("nan"), 1.0)], SCHEMA))
    rows = lambda t: {r["id"]: r["cell_id"] for r in t.assign(odd).collect()}
    assert rows(table) == rows(tree)
    window = (3.0, 3.0, 5.0, 4.5)
    assert table.zones_for_window(window).count() == tree.zones_for_window(spark, window).count()


def test_leaf_table_of_little_data(spark, points):
    for few in (points.limit(0), points.limit(1), points.filter("x = 3.0")):
        table, tree = quadtable.QuadTable.fit(few, 4, depth=9), cells.QuadTree.fit(few, 4, depth=9)
        assert table.n_leaves == len(tree.leaves) and table.assign(few).filter("cell_id IS NULL").count() == 0
        got = [(r["start"], r["level"], r["n"]) for r in table.leaves.orderBy("cell_id").collect()]
        assert got == list(tree.leaves)
