from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrafold.operators import diagnostics, distance, lookup, prepare, profile, sampling
from terrafold.plans.extent import Extent, extent

BOX = (0.0, 0.0, 10.0, 10.0)
SCHEMA = "id bigint, x double, y double"


@pytest.fixture(scope="module")
def raw(spark):
    nan = float("nan")
    rows = [(1, 1.0, 1.0), (2, None, 1.0), (3, 0.0, 0.0), (4, 0.0, 5.0), (5, 11.0, 5.0), (6, nan, 1.0), (7, 10.0, 10.0)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_cleaning(raw):
    assert ids(prepare.drop_missing(raw)) == [1, 3, 4, 5, 7]
    assert 4 in ids(prepare.drop_zero_island(raw)) and 3 not in ids(prepare.drop_zero_island(raw))
    assert ids(prepare.clean_points(raw, BOX)) == [1, 4, 7]
    assert ids(prepare.clean_points(raw, BOX, zero_island=False)) == [1, 3, 4, 7]


def test_validity_report_first_reason_wins(raw):
    r = prepare.validity_report(raw, BOX).first()
    assert (r["n_raw"], r["n_valid"], r["n_missing"], r["n_zero_island"], r["n_out_of_box"]) == (7, 3, 2, 1, 1)
    assert r["n_dropped"] == 4 and r["drop_rate"] == pytest.approx(4 / 7)
    assert prepare.validity_report(raw.filter("id < 0"), BOX).first()["drop_rate"] is None


def test_constant_axis_becomes_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], SCHEMA)
    rows = prepare.minmax_normalize(df).orderBy("id").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(0.0, 0.0), (0.0, 1.0)]


def test_empty_extent(spark):
    empty = spark.createDataFrame([], SCHEMA)
    r = extent(empty).first()
    assert r["n"] == 0 and r["min_x"] is None
    assert Extent.of(empty).n == 0
    assert profile.grid_density(empty, 3).agg(F.sum("n"), F.count("n")).first() == (0, 9)


def test_lookup_returns_duplicates(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 2.0)], SCHEMA)
    assert ids(lookup.point_lookup(df, 1.0, 1.0)) == [1, 2]
    assert ids(lookup.point_lookup(df, 1.0, 1.0, distinct=True)) == [1]
    assert lookup.point_exists(df, 2.0, 2.0).first()["found"]
    assert not lookup.point_exists(df, 2.0, 1.0).first()["found"]
    probes = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "qid int, qx double, qy double")
    found = {r["qid"]: r["found"] for r in lookup.points_exist(df, probes).collect()}
    assert found == {1: True, 2: False}


def test_window_edge_on_a_run_of_equal_y(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(50)], SCHEMA)
    assert lookup.range_query(df, (0.0, 0.0, 49.0, 5.0)).count() == 50
    assert lookup.range_query(df, (0.0, 5.0, 49.0, 9.0)).count() == 50
    assert lookup.range_query(df, (49.0, 9.0, 0.0, 0.0)).count() == 0
    assert lookup.circle_query(df, 10.0, 5.0, 2.0).count() == 5
    assert lookup.circle_query(df, 10.0, 5.0, -2.0).count() == 0


def test_distance_across_the_antimeridian_and_pole(spark):
    df = spark.createDataFrame([(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 0.0, 0.0), (4, 89.99, 10.0), (5, 89.99, -170.0)],
                               "id bigint, lat double, lon double")
    assert ids(distance.distance_query(df, 0.0, 180.0, 5_000.0)) == [1, 2]
    assert ids(distance.distance_query(df, 89.99, 10.0, 5_000.0)) == [4, 5]
    assert ids(distance.distance_query(df, 0.0, 0.0, 0.0)) == [3]


def test_sampling(spark):
    df = spark.range(1000).selectExpr("id", "double(id) x", "double(id) y")
    a = ids(sampling.sample_points(df.repartition(3), 20))
    assert a == ids(sampling.sample_points(df.repartition(7), 20)) and len(a) == 20
    assert a != ids(sampling.sample_points(df, 20, seed=1))
    for bad in (0.0, 1.5, -1.0):
        with pytest.raises(ValueError):
            sampling.sample_fraction(df, bad, 1)
    e = Extent.of(df)
    q = sampling.random_points(spark, e, 50)
    assert q.filter(F.col("qx").between(e.min_x, e.max_x) & F.col("qy").between(e.min_y, e.max_y)).count() == 50
    w = sampling.selectivity_windows(q, e.area, (0.01, 0.04)).withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    assert w.groupBy("lvl").agg(F.round(F.avg("area") / e.area, 6).alias("s")).orderBy("lvl").collect() == [(0, 0.01), (1, 0.04)]


def test_runtime_summary_and_speedup(spark):
    runs = spark.createDataFrame([("a", "q", 2.0), ("a", "q", 4.0), ("b", "q", 1.0), ("b", "p", 5.0)], "v string, q string, t double")
    rows = {r["v"]: r for r in diagnostics.runtime_summary(runs.filter("q = 'q'"), "v", "t").collect()}
    assert rows["b"]["std_samp"] == 0.0 and rows["b"]["rank"] == 1 and rows["a"]["rank"] == 2
    assert rows["a"]["std_pop"] == 1.0 and rows["a"]["avg"] == 3.0
    ratio = {r["q"]: r["speedup"] for r in diagnostics.speedup(runs, "q", "v", "t", "a", "b").collect()}
    assert ratio == {"q": 3.0, "p": None}
    zero = spark.createDataFrame([("a", "q", 2.0), ("b", "q", 0.0)], "v string, q string, t double")
    assert diagnostics.speedup(zero, "q", "v", "t", "a", "b").first()["speedup"] is None


def test_quantile_profile_counts_outliers(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 100)] + [(1000, 1e6, 0.0)], SCHEMA)
    r = profile.quantile_profile(df, "x").first()
    assert r["median"] == 50.5 and r["n_outliers"] == 1
    rough = profile.approximate_quantiles(df, "x", [0.25, 0.5]).first()["quantiles"]
    assert rough == [25.0, 50.0]


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 5.0, 0.0), (4, 99.0, 0.0)], SCHEMA)
    assert [r["n"] for r in profile.histogram(df, "x", 2, 0.0, 10.0).orderBy("bin").collect()] == [1, 2]
