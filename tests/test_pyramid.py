"""Batch joins against brute force, on data where a third of the rows share a place and a third share an x."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from terrafold.operators import joins, lookup, nearest
from terrafold.plans import pyramid
from terrafold.plans.pyramid import NestedGrid, PointIndex, RankGrid
from terrafold.sources import readers

N = 3_000


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    third = N // 3
    x = np.concatenate([np.full(third, 40.0), np.full(third, 70.0), rng.uniform(0, 100, third)])
    y = np.concatenate([np.full(third, 20.0), np.round(rng.uniform(0, 50, third), 1), rng.uniform(0, 50, third)])
    order = rng.permutation(N)
    return pd.DataFrame({"id": np.arange(N), "x": x[order], "y": y[order]})


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame(data).repartition(5)


LIMITS = {"plain": {}, "salted": {"hot_rows": 40}, "nested": {"cell_bits": 4}, "nested-salted": {"cell_bits": 4, "hot_rows": 40}}


@pytest.fixture(scope="module", params=list(LIMITS))
def index(request, points):
    built = PointIndex.build(points, per_cell=8, **LIMITS[request.param])
    assert (built.hot is not None) == ("salted" in request.param)
    assert isinstance(built.grid, NestedGrid) == ("nested" in request.param)
    return built


@pytest.fixture(scope="module")
def boxes():
    rng = np.random.default_rng(8)
    c = np.column_stack([rng.uniform(-5, 105, 60), rng.uniform(-5, 55, 60)])
    h = rng.uniform(0, 12, (60, 2))
    rows = [(i, *(c[i] - h[i]), *(c[i] + h[i])) for i in range(60)]
    rows += [
        (100, 40.0, 20.0, 40.0, 20.0),  # exactly the hot place
        (101, 70.0, 0.0, 70.0, 50.0),  # exactly the hot line
        (102, -1e9, -1e9, 1e9, 1e9),  # everything
        (103, 50.0, 40.0, 40.0, 30.0),  # inverted
        (104, 200.0, 200.0, 300.0, 300.0),  # outside
        (105, 40.0, 20.0, 70.0, 20.0),  # edges on runs of equal values
    ]
    return pd.DataFrame([[float(v) if j else int(v) for j, v in enumerate(r)] for r in rows],
                        columns=["qid", "min_x", "min_y", "max_x", "max_y"])


def inside(data, w):
    return data[(data.x >= w.min_x) & (data.x <= w.max_x) & (data.y >= w.min_y) & (data.y <= w.max_y)]


def test_window_counts(spark, index, data, boxes):
    got = {r["qid"]: r["n"] for r in joins.window_counts(index, spark.createDataFrame(boxes)).collect()}
    assert got == {w.qid: len(inside(data, w)) for w in boxes.itertuples()}


def test_window_join(spark, index, data, boxes):
    got = sorted((r["qid"], r["id"]) for r in joins.window_join(index, spark.createDataFrame(boxes)).collect())
    assert got == sorted((w.qid, i) for w in boxes.itertuples() for i in inside(data, w).id)


def crosses(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


RINGS = {
    0: [(10.0, 5.0), (90.0, 5.0), (90.0, 45.0), (50.0, 10.0), (10.0, 45.0)],  # concave, holds the hot places
    1: [(40.0, 20.0), (45.0, 20.0), (45.0, 25.0), (40.0, 25.0)],  # corner on the hot place
    2: [(60.0, 10.0), (80.0, 12.0), (70.0, 40.0)],
    3: [(300.0, 0.0), (310.0, 0.0), (305.0, 9.0)],
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in RINGS.items()]
    return spark.createDataFrame(rows, "poly_id int, ring array<struct<x double, y double>>")


def brute_pairs(data):
    return {(k, p.id) for p in data.itertuples() for k, ring in RINGS.items() if crosses(ring, p.x, p.y)}


def test_polygon_joins(spark, index, data, shapes):
    want = brute_pairs(data)
    assert {(r["poly_id"], r["id"]) for r in joins.polygon_join(index, shapes).collect()} == want
    counts = {r["poly_id"]: r["n"] for r in joins.polygon_counts(index, shapes).collect()}
    assert counts == {k: sum(1 for p in want if p[0] == k) for k in RINGS}
    edges = [(k, i, *a, *b) for k, ring in RINGS.items() for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    table = spark.createDataFrame(edges, "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    assert {(r["poly_id"], r["id"]) for r in joins.polygon_join_by_edges(index, table).collect()} == want


def test_polygon_pairs_carry_clipped_edges(spark, index, data):
    """A ring of many edges: the result is exact and a border pair holds the edges near its cell only."""
    t = np.linspace(0, 2 * np.pi, 2000, endpoint=False)
    r = 20 + 3 * np.sin(40 * t)
    ring = [(float(50 + a), float(25 + b)) for a, b in zip(r * np.cos(t), r * np.sin(t))]
    shape = spark.createDataFrame([(1, ring)], "poly_id int, ring array<struct<x double, y double>>")
    xs, ys = data.x.to_numpy(), data.y.to_numpy()
    inside = np.zeros(len(data), dtype=bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            inside ^= ((y1 > ys) != (y2 > ys)) & (xs < (x2 - x1) * (ys - y1) / (y2 - y1) + x1)
    want = sorted(data.id[inside])
    assert sorted(r["id"] for r in joins.polygon_join(index, shape).collect()) == want and want
    assert joins.polygon_counts(index, shape).first()["n"] == len(want)
    pairs = joins._polygon_pairs(index, shape, "poly_id", settle=False)
    held = pairs.groupBy("covered").agg(F.max(F.size("edges")).alias("most"), F.avg(F.size("edges")).alias("mean")).collect()
    held = {r["covered"]: r for r in held}
    assert held[False]["mean"] < 500 and (True not in held or held[True]["most"] == 0)


def test_semi_and_anti_split_the_points(index, data, shapes):
    hit = {i for _, i in brute_pairs(data)}
    got = [r["id"] for r in joins.points_in_any_polygon(index, shapes).collect()]
    rest = [r["id"] for r in joins.points_in_no_polygon(index, shapes).collect()]
    assert sorted(got) == sorted(hit)
    assert sorted(rest) == sorted(set(data.id) - hit)


@pytest.fixture(scope="module")
def asked():
    rng = np.random.default_rng(9)
    rows = np.column_stack([rng.uniform(-20, 120, 25), rng.uniform(-20, 70, 25)])
    special = [(40.0, 20.0), (70.0, 25.0), (40.001, 20.0), (1e4, 1e4)]
    q = np.vstack([rows, special])
    return pd.DataFrame({"qid": np.arange(len(q)), "qx": q[:, 0], "qy": q[:, 1]})


def brute_knn(data, qx, qy, k):
    dx, dy = data.x - qx, data.y - qy
    ranked = data.assign(d=np.sqrt(dx * dx + dy * dy)).sort_values(["d", "x", "y", "id"])
    return list(ranked.id[:k])


@pytest.mark.parametrize("k", [1, 10, 100])
def test_knn_join(spark, index, data, asked, k):
    rows = nearest.knn_join(index, spark.createDataFrame(asked), k).collect()
    got: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {q.qid: brute_knn(data, q.qx, q.qy, k) for q in asked.itertuples()}


def test_knn_more_than_there_are(spark, points, data):
    few = points.filter("id < 20")
    small = PointIndex.build(few, per_cell=4)
    ask = spark.createDataFrame([(1, 50.0, 25.0)], "qid int, qx double, qy double")
    assert nearest.knn_join(small, ask, 50).count() == 20
    assert nearest.knn(few, 50.0, 25.0, 50).count() == 20
    with pytest.raises(ValueError):
        nearest.knn(few, 0.0, 0.0, 0)


def test_knn_single_matches_brute(points, data):
    got = [r["id"] for r in nearest.knn(points, 41.0, 20.0, 30).collect()]
    assert got == brute_knn(data, 41.0, 20.0, 30)


def test_sweep_is_prefix_of_largest(spark, index, asked):
    rows = nearest.knn_sweep(index, spark.createDataFrame(asked), [1, 5]).groupBy("qid", "k").count().collect()
    assert {(r["k"], r["count"]) for r in rows} == {(1, 1), (5, 5)} and len(rows) == 2 * len(asked)


def test_empty_and_missing(spark, boxes):
    schema = "id bigint, x double, y double"
    empty = PointIndex.build(spark.createDataFrame([], schema))
    w = spark.createDataFrame(boxes)
    assert joins.window_counts(empty, w).agg(F.sum("n")).first()[0] == 0
    holes = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 2.0, None), (5, 2.0, 2.0)], schema
    )
    index = PointIndex.build(holes)
    ask = spark.createDataFrame([(1, 0.0, 0.0)], "qid int, qx double, qy double")
    assert [r["id"] for r in nearest.knn_join(index, ask, 3).orderBy("rank").collect()] == [1, 5]
    assert [r["id"] for r in nearest.knn(holes, 0.0, 0.0, 3).collect()] == [1, 5]


def test_plans_have_no_cross_or_nested_loop(spark, index, boxes, asked, shapes):
    frames = [
        joins.window_counts(index, spark.createDataFrame(boxes)),
        joins.window_join(index, spark.createDataFrame(boxes)),
        joins.polygon_join(index, shapes),
        joins.polygon_counts(index, shapes),
        joins.points_in_no_polygon(index, shapes),
        nearest.knn_join(index, spark.createDataFrame(asked), 5),
    ]
    for df in frames:
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan_of(frames[-1])


def test_nested_lists_are_bounded_and_whole(spark, index, data, shapes):
    pairs = joins.polygon_join(index, shapes)
    nested = joins.nested_points(pairs, ids_per_list=100).collect()
    assert max(len(r["ids"]) for r in nested) <= 100
    assert sorted((r["poly_id"], i) for r in nested for i in r["ids"]) == sorted(brute_pairs(data))


@pytest.mark.parametrize("per_folder", [1_000_000, 10], ids=["16 folders", "256 folders"])
def test_one_window_reads_its_folders_only(spark, points, data, per_folder):
    index = PointIndex.build(points, per_cell=8, rows_per_folder=per_folder)
    box = (10.0, 25.0, 20.0, 45.0)
    one = spark.createDataFrame([(1, *box)], "qid int, min_x double, min_y double, max_x double, max_y double")
    found = joins.window_join(index, one)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(part for part in plan.split("\n\n") if "Scan parquet" in part and "PartitionFilters" in part and "__node" in part)
    assert "__node" in scan.split("PartitionFilters:")[1].split("\n")[0]
    pushed = scan.split("PushedFilters:")[1].split("\n")[0]
    assert "GreaterThanOrEqual(bx" in pushed and "LessThanOrEqual(by" in pushed
    assert "hashpartitioning(bx" not in plan  # the points stay where they are
    folders = {p.split("__node=")[1].split("/")[0] for p in index.points.inputFiles()}
    read = {p.split("__node=")[1].split("/")[0] for p in index.touched(joins._window_pairs(index, one, "qid", False), index.points).inputFiles()}
    assert index.folder_level == (1 if per_folder == 10 else 0) and len(folders) > 16 * index.folder_level and read <= folders
    w = next(pd.DataFrame([(1, *box)], columns=["qid", "min_x", "min_y", "max_x", "max_y"]).itertuples())
    assert sorted(r["id"] for r in found.collect()) == sorted(inside(data, w).id)


def test_a_hot_cell_is_split_into_bounded_parts(index, data):
    if index.hot is None:
        return
    parts = index.points.filter("bx IS NOT NULL").groupBy("bx", "by", "__salt").count()
    assert parts.agg(F.max("count")).first()[0] < 3 * 40
    assert index.points.filter("__single").count() >= len(data) // 3


def test_windows_that_repeat_a_key_keep_their_own_counts(spark, index, data, boxes):
    rows = [(1, 0.0, 0.0, 100.0, 50.0), (1, 0.0, 0.0, 100.0, 50.0), (1, 40.0, 20.0, 40.0, 20.0), (1, None, 0.0, 1.0, 1.0)]
    asked = spark.createDataFrame(rows, "qid int, min_x double, min_y double, max_x double, max_y double")
    got = sorted(r["n"] for r in joins.window_counts(index, asked).collect())
    assert got == sorted([0, int(((data.x == 40) & (data.y == 20)).sum()), len(data), len(data)])


def test_edges_meet_points_on_polygon_and_slab(spark):
    """A ring of many edges: equal to the array form, and no join of points and edges on the polygon alone."""
    rng = np.random.default_rng(9)
    n = 2_000
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-10, 10, (4_000, 2)))], "id bigint, x double, y double")
    index = PointIndex.build(pts, per_cell=16)
    turn, radius = np.linspace(0, 2 * np.pi, n, endpoint=False), rng.uniform(3, 9, n)
    ring = [(float(r * np.cos(t)), float(r * np.sin(t))) for r, t in zip(radius, turn)]
    square = [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]
    both = spark.createDataFrame([(k, i, *v) for k, vs in ((1, ring), (2, square)) for i, v in enumerate(vs)], "poly_id bigint, seq bigint, x double, y double")
    edges = readers.edges_from_vertices(both)
    joined = joins.polygon_join_by_edges(index, edges)
    got = sorted(map(tuple, joined.select("poly_id", "id").collect()))
    want = sorted(map(tuple, joins.polygon_join(index, readers.rings_from_vertices(both)).select("poly_id", "id").collect()))
    assert got == want and len(want) > 1_000
    slabs = joins.edge_slabs(index, edges)
    per_slab = slabs.groupBy("poly_id", "by").count().agg(F.max("count")).first()[0]
    assert per_slab < n / 2 and not slabs.filter("c0 > c1").count()
    plan = plan_of(joined)
    keys = [line for line in plan.splitlines() if "Join" in line and "by#" in line]
    assert keys and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_probes_walk_the_pyramid(spark):
    pts = spark.createDataFrame([(i, float(i % 40), float(i // 40)) for i in range(4_000)] + [(5_000, None, 1.0)], "id bigint, x double, y double")
    index = PointIndex.build(pts, per_cell=16, rows_per_folder=100)
    probes = spark.createDataFrame([(1, 3.0, 5.0), (2, 3.0, 5.0), (3, 3.5, 5.0), (4, None, 1.0), (5, 1e9, 0.0)], "qid int, qx double, qy double")
    for got in (lookup.indexed_points_exist(index, probes), lookup.points_exist(pts, probes)):
        assert {r["qid"]: r["found"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    plan = plan_of(lookup.points_exist(pts, probes))
    assert "BroadcastHashJoin" in plan


def test_nested_cells_keep_their_size(points, data):
    """Cells of one coarse grid hold hundreds of points; nested ones only their share, unless they are one place."""
    coarse = RankGrid.fit(points, N, per_cell=8, cell_bits=4).add(points).groupBy("bx", "by").count()
    assert coarse.agg(F.max("count")).first()[0] > 300
    index = PointIndex.build(points, per_cell=8, cell_bits=4)
    assert sum(index.grid.width) > sum(index.grid.base.width) and index.grid.shifts[-1] == (0, 0)
    cells = index.points.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x", "y").alias("places"))
    most = {r["one"]: r["n"] for r in cells.groupBy((F.col("places") == 1).alias("one")).agg(F.max("n").alias("n")).collect()}
    assert most[False] <= 8 * 2**pyramid.MIN_CELL_BITS and most[True] >= N // 3
    assert index.pyramid.groupBy("level").agg(F.sum("n").alias("n")).filter(F.col("n") != N).count() == 0


def test_nested_cells_follow_the_order_of_the_axis(points):
    """A later bucket never begins before an earlier one ends, within an outer cell."""
    grid = pyramid.fit_grid(points, N, 8, 4)
    ix = grid.width[0] - grid.base.width[0]
    placed = grid.add(points)
    spans = placed.groupBy(F.shiftright("bx", ix).alias("ox"), F.shiftright("by", grid.width[1] - grid.base.width[1]).alias("oy"), "bx")
    rows = spans.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("ox", "oy", "bx").collect()
    for a, b in zip(rows, rows[1:]):
        assert (a["ox"], a["oy"]) != (b["ox"], b["oy"]) or a["hi"] < b["lo"]


def test_inner_cuts_are_joined_by_salted_cells_beyond_a_size(monkeypatch, points, data):
    monkeypatch.setattr(pyramid, "BROADCAST_CUTS", 0)
    monkeypatch.setattr(pyramid, "BROADCAST_ROWS", 0)
    grid = pyramid.fit_grid(points, N, 8, 4)
    placed = grid.add(points)
    assert not grid.light and placed.count() == N and placed.columns == ["id", "x", "y", "bx", "by"]
    wide = PointIndex.build(points, per_cell=8, cell_bits=4)
    assert wide.points.select("id").distinct().count() == N


def test_next_double(spark):
    rng = np.random.default_rng(5)
    values = [0.0, 1.0, -1.0, 2.0, -2.0, 1.5, 1e300, -1e-300, 0.1, *rng.normal(0, 1e3, 500).tolist(), *(2.0 ** np.arange(-60, 60)).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", pyramid.next_double(F.col("v")).alias("w")).collect()
    assert all(r["w"] == np.nextafter(r["v"], np.inf) for r in got)
