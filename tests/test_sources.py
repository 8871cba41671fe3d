from __future__ import annotations

import pytest

from terrafold.operators import lookup
from terrafold.sources import readers, sinks
from terrafold.streaming.filters import read_point_stream, run_to_files


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def xy(df):
    return sorted(((r["x"], r["y"]) for r in df.collect()), key=str)


def test_points_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", "7,1.5,2.5,extra\n8,bad,3.0,extra\n9,4,5,extra\n")
    assert xy(readers.read_points_csv(spark, path, offset=1)) == sorted([(1.5, 2.5), (None, 3.0), (4.0, 5.0)], key=str)
    with pytest.raises(Exception):
        readers.read_points_csv(spark, path, offset=1, mode="FAILFAST").collect()
    headed = put(tmp_path, "b.csv", "x,y\n1,2\n")
    assert xy(readers.read_points_csv(spark, headed, header=True)) == [(1.0, 2.0)]
    assert readers.read_points_csv(spark, headed, header=True, with_id=False).columns == ["x", "y"]


def test_points_json(spark, tmp_path):
    lines = [
        '{"id": 1, "g": "POINT (-73.5 40.25)"}', '{"g": "POINT (1 2)"}', '{"g":"POINT (1e2 -2.5E-1)"}',
        '{"g": "LINE (1 2)"}', "not json", '{"h": 1}',
    ]
    df = readers.read_points_json(spark, put(tmp_path, "p.json", "\n".join(lines)))
    assert df.count() == 6
    assert xy(df.na.drop(subset=["x", "y"])) == sorted([(-73.5, 40.25), (1.0, 2.0), (100.0, -0.25)], key=str)


def test_windows_csv(spark, tmp_path):
    df = readers.read_windows_csv(spark, put(tmp_path, "w.csv", "fromX,fromY,toX,toY\n0,1,2,3\n"))
    r = df.first()
    assert (r["min_x"], r["min_y"], r["max_x"], r["max_y"]) == (0.0, 1.0, 2.0, 3.0) and "qid" in df.columns


def test_polygons(spark, tmp_path):
    text = "polygon_id,seq,x,y\n1,2,1,1\n1,0,0,0\n1,1,1,0\n2,0,5,5\n2,1,6,5\n2,2,6,6\n2,3,5,5\n"
    path = put(tmp_path, "poly.csv", text)
    rings = {r["poly_id"]: [(v["x"], v["y"]) for v in r["ring"]] for r in readers.read_polygons_csv(spark, path).collect()}
    assert rings[1] == [(0, 0), (1, 0), (1, 1)] and len(rings[2]) == 4
    edges = readers.edges_from_vertices(readers.read_vertices_csv(spark, path), chunk=2).collect()
    assert sorted(r["poly_id"] for r in edges) == [1, 1, 1, 2, 2, 2]  # closing edge added once, none of length 0
    assert {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in edges if r["poly_id"] == 1} == {
        (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)
    }


def test_vertex_runs(spark):
    rows = spark.range(12).selectExpr("id as row_no", "double(id) as x", "double(id) as y")
    runs = readers.vertex_runs(rows)
    assert {(r["poly_id"], r["seq"]) for r in runs.collect()} == {(p, s) for p in (0, 1) for s in range(5)}
    assert [(r["poly_id"], r["vertices"]) for r in readers.incomplete_runs(rows).collect()] == [(2, 2)]


def test_merge(spark, tmp_path):
    put(tmp_path, "m1.csv", "x,y\n1,2\n3,4\n")
    put(tmp_path, "m2.csv", "y,x,z\n6,5,7\n")
    df = readers.read_many(spark, [str(tmp_path / "m1*.csv"), str(tmp_path / "m2*.csv")])
    rows = sorted((r["x"], r["y"], r["z"], r["source"][-6:]) for r in df.fillna("-").collect())
    assert rows == [("1", "2", "-", "m1.csv"), ("3", "4", "-", "m1.csv"), ("5", "6", "7", "m2.csv")]


def test_build_log(spark, tmp_path):
    text = (
        "--- Run 1 ---\n----databuild QPIndexBuild:\nIndex build time : 100\n----databuild KPIndexBuild:\nIndex build time : 250\n"
        "--- Run 2 FAILED ---\n----databuild QPIndexBuild:\nIndex build time : 1\n"
        "--- Run 10 ---\n----databuild QPIndexBuild:\nIndex build time : 110\n"
    )
    df = readers.read_build_log(spark, put(tmp_path, "log.txt", text))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "KP", 250), (1, "QP", 100), (10, "QP", 110)]


def test_append_report(spark, tmp_path):
    path = str(tmp_path / "report")
    for i in range(2):
        sinks.append_report(spark.createDataFrame([(i,)], "n int"), path, "parquet")
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [0, 1]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    points = spark.range(500).selectExpr("id", "double(id % 50) as x", "double(id % 7) as y")
    points.repartition(3).write.parquet(source)
    window = (10.0, 2.0, 20.0, 5.0)
    stream = read_point_stream(spark, source, points.schema)
    out = run_to_files(stream, str(tmp_path / "out"), lambda df: lookup.range_query(df, window))
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in lookup.range_query(points, window).collect())
