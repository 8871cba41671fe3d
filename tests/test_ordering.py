from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from terrafold.plans.ordering import (
    PART, Cuts, RangeOrder, add_buckets, exact_quantiles, in_ranges, number_rows, running_total, with_neighbours,
)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 4_000
    y = np.where(rng.random(n) < 0.35, 5.0, rng.uniform(0, 10, n))
    x = np.where(rng.random(n) < 0.5, 1.0, rng.uniform(0, 3, n))
    return pd.DataFrame({"id": rng.permutation(n), "x": x, "y": y, "g": rng.integers(0, 3, n)})


def test_cuts_fence_heavy_values():
    cuts = Cuts.from_quantiles([1.0, 2.0, 2.0, 2.0, 7.0])
    assert cuts.values == (1.0, 2.0, math.nextafter(2.0, math.inf), 7.0)
    assert cuts.heavy == (2,)


def test_buckets_keep_order(spark, rows):
    df = spark.createDataFrame(rows)
    ranges = RangeOrder.fit(df, ["y", "x", "id"], len(rows), buckets=16)
    assert ranges.depth == 3
    got = ranges.add(df).orderBy("y", "x", "id").select(*ranges.names).toPandas()
    assert list(got.itertuples(index=False)) == sorted(got.itertuples(index=False))
    sizes = ranges.add(df).groupBy(*ranges.names).count().agg(F.max("count")).first()[0]
    assert sizes < len(rows) / 8  # although a sixth of the rows agree on both x and y


@pytest.mark.parametrize("by", [[], ["g"]])
def test_number_rows(spark, rows, by):
    df = spark.createDataFrame(rows)
    got = number_rows(df, ["y", "x", "id"], by=by, buckets=RangeOrder.fit(df, ["y", "x", "id"], len(rows), 16)).toPandas()
    want = rows.sort_values([*by, "y", "x", "id"]).reset_index(drop=True)
    want["row_no"] = want.groupby(by).cumcount() if by else want.index
    merged = got.merge(want[["id", "row_no"]], on="id", suffixes=("", "_w"))
    assert len(merged) == len(rows) and (merged.row_no == merged.row_no_w).all()


def test_number_rows_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 1.0)], "id int, v double")
    got = {r["id"]: r["row_no"] for r in number_rows(df, ["v", "id"]).collect()}
    assert got == {2: 0, 3: 1, 1: 2}


def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, "y", probs, by=["g"]).collect()}
    for g, part in rows.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part.y, p))
    assert exact_quantiles(df.filter("y < 0"), "y", probs).count() == 0


def test_neighbours_see_across_chunks(spark):
    df = spark.range(10).withColumnRenamed("id", "no")
    out = with_neighbours(df, "no", 3)
    assert out.filter("__own").count() == 10
    seen = out.groupBy("__chunk").agg(F.min("no").alias("a"), F.max("no").alias("b")).orderBy("__chunk").collect()
    assert [(r["a"], r["b"]) for r in seen if r["__chunk"] in (0, 1, 2, 3)] == [(0, 3), (2, 6), (5, 9), (8, 9)]


def test_add_buckets_edges(spark):
    df = spark.createDataFrame([(-1e300,), (0.0,), (1.0,), (1e300,)], "v double")
    got = [r["b"] for r in add_buckets(df, b=("v", Cuts((0.0, 1.0)))).orderBy("v").collect()]
    assert got == [0, 1, 2, 2]
    assert [r["b"] for r in add_buckets(df, b=("v", Cuts(()))).collect()] == [0] * 4


def test_numbering_shuffles_rows_once(spark, rows):
    """One exchange by range under the written ranges; what is left is a join with one row per range."""
    df = spark.createDataFrame(rows)
    plan = plan_of(number_rows(df, ["y", "x", "id"]))
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    placed, parts = in_ranges(df, ["y", "x", "id"], parts=16)
    sizes = [r["n"] for r in placed.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert parts == 16 and max(sizes) < len(rows) / 8  # although a sixth of the rows agree on both x and y


def test_running_total_by_text_and_null_groups(spark):
    data = [("b", None, 1), ("a", None, 2), ("c", "g", 4), (None, "g", 8), ("d", "g", 16)]
    df = spark.createDataFrame(data, "k string, g string, v int")
    got = {(r["g"], r["k"]): r["t"] for r in running_total(df, ["k"], F.col("v"), "t", by=["g"]).collect()}
    assert got == {(None, "a"): 2, (None, "b"): 3, ("g", None): 8, ("g", "c"): 12, ("g", "d"): 28}
