from __future__ import annotations

import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from terrafold.operators import models


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.floats(0.001, 100), st.integers(1, 50)), min_size=1, max_size=300),
    st.sampled_from([0.0, 1.0, 8.0, 32.0]),
)
def test_corridor_keeps_its_bound(steps, error):
    keys = np.cumsum([s[0] for s in steps])
    ranks = np.cumsum([s[1] for s in steps]).astype(float)
    at = models.corridor(keys, ranks, error)
    assert at[0] == 0 and at[-1] == len(keys) - 1 and (np.diff(at) > 0).all()
    assert np.abs(np.interp(keys, keys[at], ranks[at]) - ranks).max() <= error + 1e-6


def test_fit_needs_no_package_on_the_workers(tmp_path):
    blob = tmp_path / "fit.bin"
    blob.write_bytes(cloudpickle.dumps(models.corridor))
    code = (
        "import pickle, sys, numpy as np; f = pickle.load(open(sys.argv[1], 'rb')); "
        "assert not any(m.startswith('terrafold') for m in sys.modules); "
        "print(list(map(int, f(np.arange(4.0), np.array([0.0, 1, 2, 9]), 0.0))))"
    )
    run = subprocess.run([sys.executable, "-c", code, str(blob)], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert run.stdout.strip() == "[0, 2, 3]", run.stderr


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    n = 5_000
    y = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(10, 4, n), 2))
    frame = pd.DataFrame({"id": np.arange(n), "x": rng.uniform(0, 1, n), "y": y, "cell_id": rng.integers(0, 2, n)})
    return spark.createDataFrame(frame)


@pytest.fixture(scope="module")
def model(points):
    return models.stored(models.cdf(points))


def test_cdf_is_rank_of_last_occurrence(points, model):
    frame = points.toPandas()
    for cell, part in frame.groupby("cell_id"):
        got = model.filter(F.col("cell_id") == cell).orderBy("key").toPandas()
        keys, counts = np.unique(part.y, return_counts=True)
        assert (got.key == keys).all() and (got["rank"] == np.cumsum(counts) - 1).all()


@pytest.mark.parametrize("chunk", [100, 100_000])
def test_fit_error_is_bounded_whatever_the_chunk(model, chunk):
    knots = models.stored(models.fit_knots(model, 16, chunk=chunk))
    assert models.fit_error(knots, model).agg(F.max("max_error")).first()[0] <= 16 + 1e-6
    assert knots.count() < model.count()


def test_lossless_knots_do_not_depend_on_chunks(model):
    a = models.lossless_knots(model, chunk=50).orderBy("cell_id", "key").collect()
    assert a == models.lossless_knots(model, chunk=10**6).orderBy("cell_id", "key").collect()
    exact = models.fit_error(models.lossless_knots(model), model).agg(F.max("max_error")).first()[0]
    assert exact == pytest.approx(0, abs=1e-6)


def test_estimates_are_clamped(spark, model):
    knots = models.stored(models.fit_knots(model, 16))
    keys = spark.createDataFrame([(0, -1e9), (0, 1e9), (1, -1e9)], "cell_id bigint, key double")
    got = {(r["cell_id"], r["key"]): r["est"] for r in models.estimate_rank(knots, keys).collect()}
    last = model.filter("cell_id = 0").agg(F.max("rank")).first()[0]
    assert got == {(0, -1e9): 0.0, (0, 1e9): float(last), (1, -1e9): 0.0}


def test_single_distinct_key(spark):
    points = spark.createDataFrame([(i, 1.0, 3.0, 0) for i in range(10)], "id int, x double, y double, cell_id int")
    model = models.stored(models.cdf(points))
    assert [tuple(r) for r in model.collect()] == [(0, 3.0, 9)]
    knots = models.stored(models.fit_knots(model))
    assert knots.count() == 1
    assert models.estimate_rank(knots, model).first()["est"] == 9.0


def test_size_bound(model):
    knots = models.stored(models.fit_within_size(model, 10))
    assert models.model_size(knots, model).agg(F.max("knots")).first()[0] <= 10


def test_size_bound_holds_over_many_chunks(spark, model):
    """Chunks far smaller than a cell: the size holds, knots lie on the curve, first and last key stay."""
    curve = {(r["cell_id"], r["key"]): r["rank"] for r in model.collect()}
    for chunk in (50, 500):
        knots = models.fit_within_size(model, 12, chunk=chunk).collect()
        per_cell = {}
        for r in knots:
            assert curve[r["cell_id"], r["key"]] == r["rank"]
            per_cell.setdefault(r["cell_id"], []).append(r["key"])
        assert max(map(len, per_cell.values())) <= 12
        for c in {c for c, _ in curve}:
            keys = [k for d, k in curve if d == c]
            assert min(per_cell[c]) == min(keys) and max(per_cell[c]) == max(keys)


def test_a_key_that_many_rows_ask(spark):
    knots = spark.createDataFrame([(0, 0.0, 0), (0, 10.0, 100)], "cell_id int, key double, rank bigint")
    asked = spark.createDataFrame([(i, 0, 4.0 if i % 3 else float(i % 10)) for i in range(3000)], "no int, cell_id int, key double")
    got = models.estimate_rank(knots, asked).collect()
    assert len(got) == 3000 and all(r["est"] == 10 * r["key"] for r in got)
