from __future__ import annotations

import glob

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators import cells, distance, lookup, nearest
from terrafold.plans.pyramid import BOX, PointIndex
from terrafold.sources.layout import ClusteredPoints

N = 4_000


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    hot = rng.random(N) < 0.34
    frame = pd.DataFrame({
        "id": np.arange(N),
        "x": np.where(hot, 50.0, rng.uniform(0, 100, N)),
        "y": np.where(hot, 50.0, rng.uniform(0, 100, N)),
    })
    return spark.createDataFrame(frame)


@pytest.fixture(scope="module")
def layout(points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "kd")
    made = ClusteredPoints.write(cells.kd_tree_cells(points, 16), path, rows_per_file=300)
    made.path = path
    assert made.is_local
    return made


def ids(df):
    return sorted(r["id"] for r in df.collect())


WINDOWS = [(10.0, 10.0, 30.0, 35.0), (50.0, 50.0, 50.0, 50.0), (-9.0, -9.0, 999.0, 999.0), (30.0, 35.0, 10.0, 10.0), (200.0, 0.0, 300.0, 1.0)]


@pytest.mark.parametrize("window", WINDOWS)
def test_same_rows_as_a_scan(points, layout, window):
    assert ids(layout.range_query(window)) == ids(lookup.range_query(points, window))
    assert layout.range_count(window).first()["n"] == lookup.range_query(points, window).count()


def test_lookup_circle_and_knn(points, layout):
    assert ids(layout.point_lookup(50.0, 50.0)) == ids(lookup.point_lookup(points, 50.0, 50.0))
    assert layout.point_lookup(-1.0, -1.0).count() == 0
    assert ids(layout.circle_query(20.0, 20.0, 9.0)) == ids(lookup.circle_query(points, 20.0, 20.0, 9.0))
    for q in ((5.0, 5.0), (50.0, 50.0), (51.0, 50.0), (-40.0, 200.0)):
        for k in (1, 10, 2_000, N + 5):
            got = [r["id"] for r in layout.knn(*q, k).collect()]
            assert got == [r["id"] for r in nearest.knn(points, *q, k).collect()]


def test_only_hit_folders_are_read(layout):
    plan = plan_of(layout.range_query((10.0, 10.0, 12.0, 12.0)))
    assert "PartitionFilters: [cell_id" in plan.replace("isnotnull(cell_id#", "cell_id") or "PartitionFilters: [" in plan and "cell_id" in plan
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x,10.0)" in plan
    report = layout.pruning_report((10.0, 10.0, 12.0, 12.0)).first()
    assert report["cells_hit"] < report["cells_total"]


def test_many_cells_prune_by_semi_join(points, layout, monkeypatch):
    monkeypatch.setattr("terrafold.sources.layout.MAX_LITERAL_CELLS", 1)
    monkeypatch.setattr("terrafold.sources.layout.BROADCAST_ROWS", 1)
    layout = type(layout)(layout.points, points.sparkSession.read.parquet(f"{layout.path}/cells"), layout.n_cells)
    window = (10.0, 10.0, 80.0, 35.0)
    out = layout.range_query(window)
    assert ids(out) == ids(lookup.range_query(points, window))
    assert "dynamicpruning" in plan_of(out)


def test_files_are_sorted_and_hot_cells_are_split(layout):
    files = glob.glob(f"{layout.path}/points/cell_id=*/*.parquet")
    for f in files:
        y = pq.ParquetFile(f).read()["y"].to_pylist()
        assert y == sorted(y)
    per_folder = pd.Series([f.split("cell_id=")[1].split("/")[0] for f in files]).value_counts()
    assert per_folder.max() > 1
    assert max(pq.ParquetFile(f).metadata.num_rows for f in files) < N // 4


def test_large_cell_tables_stay_distributed(points, layout, monkeypatch):
    monkeypatch.setattr("terrafold.sources.layout.BROADCAST_ROWS", 1)
    assert not layout.is_local
    for window in WINDOWS:
        assert layout.range_count(window).first()["n"] == lookup.range_query(points, window).count()
    got = [r["id"] for r in layout.knn(51.0, 50.0, 10).collect()]
    assert got == [r["id"] for r in nearest.knn(points, 51.0, 50.0, 10).collect()]


def test_geodesic_queries_read_only_near_cells(spark, tmp_path):
    rng = np.random.default_rng(21)
    frame = pd.DataFrame({"id": np.arange(N), "x": rng.uniform(-180, 180, N), "y": rng.uniform(-90, 90, N)})
    pts = spark.createDataFrame(frame)
    made = ClusteredPoints.write(cells.kd_tree_cells(pts, 16), str(tmp_path / "geo"))
    asked = [(1, 0.0, 179.9, 900_000.0), (2, 89.0, 10.0, 1_500_000.0), (3, 48.0, 11.0, 0.0), (4, -30.0, -60.0, 2.1e7), (5, 10.0, 10.0, -1.0)]
    index = PointIndex.build(pts, per_cell=8)
    places = spark.createDataFrame(asked, "qid int, lat double, lon double, metres double")
    joined = distance.distance_join(index, places).collect()
    counts = {r["qid"]: r["n"] for r in distance.distance_counts(index, places).collect()}
    for qid, lat, lon, metres in asked:
        want = ids(distance.distance_query(pts, lat, lon, metres, "y", "x"))
        assert ids(made.distance_query(lat, lon, metres)) == want
        assert sorted(r["id"] for r in joined if r["qid"] == qid) == want and counts[qid] == len(want)
    assert counts[4] == N and counts[1] and counts[2]
    kept = [r["cell_id"] for r in made.cells.filter(g.haversine_bounds(BOX, 0.0, 179.9)[0] <= 900_000.0).collect()]
    assert 0 < len(kept) < 16
    filters = plan_of(made.distance_query(*asked[0][1:])).split("PartitionFilters: [")[1].split("]")[0]
    assert all(str(c) in filters for c in kept) and "cell_id" in filters


def test_hot_cells_are_ranges_and_z_order_prunes_both_axes(spark, tmp_path):
    """One cell of all rows: its files hold disjoint ranges; a small window meets fewer of them in Z-order than by y."""
    rng = np.random.default_rng(31)
    x, y = rng.uniform(0, 100, N), rng.uniform(0, 100, N)
    x[: N // 3], y[: N // 3] = 50.0, 50.0
    frame = pd.DataFrame({"id": np.arange(N), "x": x, "y": y})
    frame.loc[N - 1, "x"] = None
    one = spark.createDataFrame(frame).withColumn("cell_id", F.lit(0))
    met = {}
    for order in ("y", "z"):
        made = ClusteredPoints.write(one, str(tmp_path / order), rows_per_file=100, order=order)
        for window in WINDOWS:
            assert ids(made.range_query(window)) == ids(lookup.range_query(one, window))
        files = [pq.ParquetFile(f).read().to_pandas() for f in glob.glob(f"{tmp_path}/{order}/points/cell_id=0/*.parquet")]
        assert len(files) > 20 and max(map(len, files)) < 500 and sum(map(len, files)) == N
        spans = [(f.x.min(), f.x.max(), f.y.min(), f.y.max()) for f in files]
        met[order] = sum(a <= 12 and b >= 10 and c <= 90 and d >= 10 for a, b, c, d in spans)
        if order == "y":
            ends = sorted((c, d) for _, _, c, d in spans)
            assert all(d <= c2 for (_, d), (c2, _) in zip(ends, ends[1:]))
    assert met["z"] * 2 < met["y"]
    with pytest.raises(ValueError):
        ClusteredPoints.write(one, str(tmp_path / "no"), order="hilbert")
