"""Windows meet parts of the points of a bounded size, and what they ask of one is answered from ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.values import rounded
from terrafold.operators import crossings, distance, joins, nearest, quadtable, ranges
from terrafold.operators.sketches import RANK_ERROR, SketchIndex
from terrafold.plans.pyramid import PointIndex
from terrafold.plans import pyramid, session
from terrafold.registry import core
from terrafold.sources import readers

N = 4_000
BOXES = "qid bigint, min_x double, min_y double, max_x double, max_y double"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(41)
    x, y = rng.gamma(2.0, 20.0, N).round(1), rng.normal(50, 20, N).round()
    x[: N // 4], y[: N // 4] = 40.0, 50.0
    x[N // 4 : N // 2] = 10.0
    frame = pd.DataFrame({"id": np.arange(N), "x": x, "y": y})
    frame.loc[N - 2 :, "x"] = [np.nan, np.inf]
    return frame


@pytest.fixture(scope="module")
def boxes():
    rng = np.random.default_rng(42)
    c, h = rng.uniform(-5, 105, (80, 2)), rng.uniform(0, 30, (80, 2))
    rows = [(i, *map(float, c[i] - h[i]), *map(float, c[i] + h[i])) for i in range(80)]
    return rows + [(90, 40.0, 50.0, 40.0, 50.0), (91, 10.0, -99.0, 10.0, 199.0), (92, -1e9, -1e9, 1e9, 1e9), (93, 9.0, 9.0, 1.0, 1.0)]


@pytest.fixture(scope="module", params=[{}, {"hot_rows": 100}, {"cell_bits": 4}], ids=["plain", "salted", "nested"])
def index(request, spark, data):
    return PointIndex.build(spark.createDataFrame(data), per_cell=8, **request.param)


def held(data, box):
    known = data[np.isfinite(data.x)]
    return known[known.x.between(box[1], box[3]) & known.y.between(box[2], box[4])]


def spied(monkeypatch):
    """The pairs that are stored."""
    seen, stored = [], PointIndex.stored

    def store(self, pairs):
        seen.append(stored(self, pairs))
        return seen[-1]

    monkeypatch.setattr(PointIndex, "stored", store)
    return seen


def test_ranks_of_boxes():
    rng = np.random.default_rng(43)
    for n in (1, 2, 7, 64, 500):
        x, y = rng.integers(0, 20, n).astype(float), rng.integers(0, 20, n).astype(float)
        a, b = np.sort(rng.uniform(-1, 21, (50, 2)), axis=1).T.round(), np.sort(rng.uniform(-1, 21, (50, 2)), axis=1).T.round()
        made = ranges.Ranks(x, y)
        low, high, before, found = made.window((a[0], a[1]), (b[0], b[1]))
        for i in range(50):
            inside = np.sort(x[(x >= a[0][i]) & (x <= a[1][i]) & (y >= b[0][i]) & (y <= b[1][i])])
            assert found[i] == len(inside)
            for k, v in enumerate(inside):
                assert made.nth(low[i : i + 1], high[i : i + 1], before[i : i + 1] + k)[0] == v


@pytest.mark.parametrize("rows, asked", [(262_144, 262_144), (300, 7)])
def test_counts_of_parts(spark, index, data, boxes, monkeypatch, rows, asked):
    monkeypatch.setattr(joins, "PART_ROWS", rows)
    monkeypatch.setattr(ranges, "ASKED_ROWS", asked)
    pairs = spied(monkeypatch)
    counted = joins.window_counts(index, spark.createDataFrame(boxes, BOXES))
    assert {r["qid"]: r["n"] for r in counted.collect()} == {b[0]: len(held(data, b)) for b in boxes}
    assert "FlatMapCoGroupsInArrow" in plan_of(counted)
    # a window cuts a few parts, however many cells its border crosses
    most = pairs[0].filter("NOT covered").groupBy("qid").count().agg(F.max("count")).first()[0]
    assert most <= (16 if rows > N else 80)


def test_every_point_is_in_one_part(index, data):
    for rows in (1, 50, 1_000, N):
        parts = index.in_parts(index.points.filter("bx IS NOT NULL AND by IS NOT NULL"), rows)
        found = {(r["level"], r["nx"], r["ny"]): r["n"] for r in parts.groupBy("level", "nx", "ny").agg(F.count("id").alias("n")).collect()}
        nodes = {(r["level"], r["nx"], r["ny"]): r["n"] for r in index.pyramid.collect()}
        finest = len(index.grid.shifts) - 1
        assert sum(found.values()) == N - 2 and all(nodes[k] == n and (n <= rows or k[0] == finest) for k, n in found.items())


def test_settled_pairs_are_not_dealt_by_null(spark, index, boxes, monkeypatch):
    """Covered pairs pass the joins of the walk with keys of their own: null keys all fall into one task."""
    monkeypatch.setattr("terrafold.plans.pyramid.BROADCAST_ROWS", 0)
    plan = joins._window_pairs(index, spark.createDataFrame(boxes, BOXES), "qid", True)
    assert sorted(plan.columns) == sorted(["qid", *joins.WINDOW, "nx", "ny", "n", "covered"])
    walked = index.descend(joins._named_windows(spark.createDataFrame(boxes, BOXES), "qid"), lambda box: F.lit(2), True)
    text = walked._jdf.queryExecution().analyzed().toString()
    assert "hash(" in text and walked.count() == len(boxes) * len(index.top)


@pytest.mark.parametrize("name", ["window_counts", "wild_window_counts", "window_counts_nested"])
def test_registered_counts_pair_windows_with_parts(spark, sf, monkeypatch, name):
    pairs = spied(monkeypatch)
    found = core.QUERIES[name](spark, sf)
    assert found.count() == core.windows(spark, sf).count() and "level" in pairs[-1].columns


def test_quantiles_of_many_windows_read_no_point_per_window(spark, index, data, boxes, monkeypatch):
    """What a window takes from a part has a bounded size; ranks stay within their error."""
    monkeypatch.setattr("terrafold.operators.sketches.PART_ROWS", 500)
    pairs = spied(monkeypatch)
    got = SketchIndex.build(index, rows_per_sketch=100).window_quantiles(spark.createDataFrame(boxes, BOXES), [0.0, 0.3, 1.0])
    assert "FlatMapCoGroupsInArrow" not in plan_of(got) and "level" in pairs[0].columns  # the marks are written
    for r in got.collect():
        inside = held(data, boxes[[b[0] for b in boxes].index(r["qid"])])
        assert r["n"] == len(inside) and (r["x_quantiles"] is None) == (not len(inside))
        for axis in ("x", "y") if len(inside) else ():
            values = np.sort(inside[axis].to_numpy())
            for p, v in zip([0.0, 0.3, 1.0], r[f"{axis}_quantiles"]):
                low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                assert low <= len(inside) * (p + RANK_ERROR) + 1 and high >= len(inside) * (p - RANK_ERROR) - 1


def test_quantile_check_joins_no_points(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(joins, "window_join", lambda *a, **k: asked.append(a))
    rows = core.QUERIES["window_quantiles_ok"](spark, sf).collect()
    assert rows and all(r["ok"] for r in rows) and not asked


def test_nearest_windows_hold_the_nearest(spark, index, data, boxes, monkeypatch):
    """Candidates of a window are near its middle, however many points it holds; the k nearest are among them."""
    asked = spark.createDataFrame([b for b in boxes if b[0] != 93], BOXES)
    cut = {r["qid"]: r for r in nearest.nearest_windows(index, asked, 3).collect()}
    few = {r["id"] for r in nearest.few_of_each_place(index, 3).select("id").collect()}
    for b in boxes:
        inside = held(data, b)
        if not len(inside):
            continue
        mid = np.array([(b[1] + b[3]) / 2, (b[2] + b[4]) / 2])
        dist = np.sqrt((inside.x - mid[0]) ** 2 + (inside.y - mid[1]) ** 2)
        best = inside.assign(d=dist).sort_values(["d", "x", "y", "id"]).head(3)
        r = cut[b[0]]
        near = held(data, (0, r["min_x"], r["min_y"], r["max_x"], r["max_y"]))
        assert set(best.id) <= set(near.id) & few and len(near) <= len(inside)
    everything = cut[92]
    assert len(held(data, (0, *[everything[c] for c in ("min_x", "min_y", "max_x", "max_y")]))) < N / 2


def test_distances_meet_parts(spark, index, data, monkeypatch):
    pairs = spied(monkeypatch)
    places = spark.createDataFrame([(1, 50.0, 40.0, 3e6), (2, 20.0, 10.0, 5e5), (3, 0.0, 0.0, -1.0)], "qid int, lat double, lon double, metres double")
    near = {k: sorted(r["id"] for r in distance.distance_query(spark.createDataFrame(data).filter("x < 180 AND y BETWEEN -90 AND 90"), lat, lon, m, "y", "x").collect())
            for k, lat, lon, m in ((1, 50.0, 40.0, 3e6), (2, 20.0, 10.0, 5e5))}
    joined = distance.distance_join(index, places).filter("x < 180 AND y BETWEEN -90 AND 90")
    assert {k: sorted(r["id"] for r in joined.filter(F.col("qid") == k).collect()) for k in near} == near
    assert pairs[0].groupBy("qid").count().agg(F.max("count")).first()[0] <= 16
    counts = {r["qid"]: r["n"] for r in distance.distance_counts(index, places).collect()}
    assert counts[3] == 0 and all(counts[k] >= len(v) for k, v in near.items()) and "level" in pairs[1].columns


@pytest.mark.parametrize("share", [10**9, 300], ids=["whole", "dealt"])
def test_many_windows_meet_parts_packed_in_rows(spark, data, index, boxes, monkeypatch, share):
    """A pair of the join is a window and a part of many points, in one row; parts that are one place are several rows."""
    monkeypatch.setattr(joins, "PACKED_ROWS", 100)
    monkeypatch.setattr(pyramid, "LEAST_SHARE", share)
    monkeypatch.setattr(pyramid, "MOST_SHARE", share)
    pairs = spied(monkeypatch)
    got = joins.window_join(index, spark.createDataFrame(boxes, BOXES))
    assert got.columns == ["id", "x", "y", "qid"]
    assert "posexplode(x" in plan_of(got) and "SortMergeJoin" in plan_of(got)
    large = pairs[0].filter("n > 100").select("nx", "ny").distinct().count()
    assert large <= 2 * 16 and pairs[0].count() < got.count() / 10
    want = [(b[0], i) for b in boxes for i in held(data, b).id]
    assert sorted((r["qid"], r["id"]) for r in got.collect()) == sorted(want)


def test_packed_parts_keep_missing_and_repeated_ids(spark, boxes):
    rows = [(None if i % 3 == 0 else i % 50, float(i % 40), float(i % 7), "a" if i % 2 else None) for i in range(900)]
    index = PointIndex.build(spark.createDataFrame(rows, "id bigint, x double, y double, name string"), per_cell=8)
    asked = [(i, float(i % 30), 0.0, float(i % 30 + 9), float(i % 8)) for i in range(joins.FEW_QUERIES + 1)] + [(None, 0.0, 0.0, 3.0, 3.0)]
    got = joins.window_join(index, spark.createDataFrame(asked + asked[:5], BOXES)).select("qid", "id", "x", "y", "name")
    want = [(w[0], *p) for w in asked for p in rows if w[1] <= p[1] <= w[3] and w[2] <= p[2] <= w[4]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_many_places_meet_parts_packed_in_rows(spark, monkeypatch):
    """All over the globe, at poles and at 180 degrees: the pairs and metres of the plain test."""
    monkeypatch.setattr(distance, "PACKED_ROWS", 100)
    rng = np.random.default_rng(47)
    at = np.c_[rng.uniform(-180, 180, 3_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 3_000)))].round(4)
    at[:4] = [(180.0, 10.0), (-180.0, 10.0), (20.0, 90.0), (20.0, -90.0)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id bigint, x double, y double")
    asked = [(i, float(at[9 * i, 1]), float(at[9 * i, 0]), float(m)) for i, m in enumerate(10 ** rng.uniform(4, 7, 80))]
    asked += [(90, 89.5, 0.0, 3e5), (91, -90.0, 7.0, 4e5), (92, 10.0, 179.99, 2e6), (93, 0.0, 0.0, 2.1e7), (94, at[5, 1].item(), at[5, 0].item(), 0.0), (95, 1.0, 1.0, -1.0)]
    places = spark.createDataFrame(asked, "qid bigint, lat double, lon double, metres double")
    pairs = spied(monkeypatch)
    joined = distance.distance_join(PointIndex.build(points, per_cell=8), places)
    assert joined.columns == ["id", "x", "y", "qid", "dist_m"] and "posexplode(x" in plan_of(joined)
    far = points.crossJoin(places).withColumn("dist_m", g.haversine_m("y", "x", "lat", "lon")).filter("dist_m <= metres")
    want = sorted(map(tuple, far.select("qid", "id", "dist_m").collect()))
    assert sorted(map(tuple, joined.select("qid", "id", "dist_m").collect())) == want and len(want) > pairs[0].count()


def test_rounding_without_decimals_is_the_same(spark):
    rng = np.random.default_rng(48)
    ties = [k / 2000 for k in range(-4_001, 4_001)]
    rows = [*ties, *np.nextafter(ties, 9e9), *np.nextafter(ties, -9e9), *rng.uniform(-2e4, 2e4, 5_000), *rng.uniform(0, 2e7, 2_000), 1e300, float("nan"), float("inf"), None]
    values = spark.createDataFrame([(None if v is None else float(v),) for v in rows], "v double")
    assert not values.filter(~rounded(F.col("v"), 3).eqNullSafe(F.round("v", 3))).count()


def test_crossings_of_layers():
    rng = np.random.default_rng(44)
    x, y = rng.integers(0, 30, (2, 400)) / 2
    e = rng.integers(0, 30, (4, 300)) / 2
    e = e[:, e[1] != e[3]]
    x1, y1, x2, y2 = e[:, :, None]
    want = (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(axis=0)
    for layer in (1, 7, 50, 1_000):
        assert (crossings.crossings(x, y, e, layer) == want).all()


def test_slabs_are_dealt_to_tasks_of_bounded_size(spark, index, data, monkeypatch):
    """The same pairs when a slab's points and edges are dealt to many tasks; no row per point and edge is joined."""
    turn, radius = np.linspace(0, 2 * np.pi, 600, endpoint=False), np.random.default_rng(45).uniform(5, 60, 600)
    ring = [(1, i, float(50 + r * np.cos(t)), float(50 + r * np.sin(t))) for i, (t, r) in enumerate(zip(turn, radius))]
    edges = readers.edges_from_vertices(spark.createDataFrame(ring, "poly_id int, seq bigint, x double, y double"))
    want = sorted(r["id"] for r in joins.polygon_join(index, readers.rings_from_vertices(spark.createDataFrame(ring, "poly_id int, seq bigint, x double, y double"))).collect())
    monkeypatch.setattr(joins, "SLAB_ROWS", 200)
    got = joins.polygon_join_by_edges(index, edges)
    assert sorted(r["id"] for r in got.collect()) == want and want
    assert "FlatMapCoGroupsInArrow" in plan_of(got)


def test_quad_table_counts_points_without_a_filter_on_them(spark, data, monkeypatch):
    """A filter on the number repeats the expression of both slots for every digit."""
    seen = []
    monkeypatch.setattr(quadtable, "written", lambda df, name, **k: (seen.append(plan_of(df)), session.written(df, name, **k))[1])
    made = quadtable.QuadTable.fit(spark.createDataFrame(data), 16, 6)
    assert made.leaves.agg(F.sum("n")).first()[0] == N - 2
    assert "Filter" not in seen[0]


def test_queries_are_dealt_to_all_tasks(spark, index):
    """Few bytes of queries meet many nodes, so the walk must not run in the one task they would fill."""
    places = spark.createDataFrame([(i, 50.0, 40.0, 1e5) for i in range(1_000)], "qid int, lat double, lon double, metres double")
    walked = index.descend(places.distinct(), lambda box: F.lit(1), True)
    assert walked.select(F.spark_partition_id().alias("p")).distinct().count() > 1
