"""Distribution models."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import models
from terrafold.registry import core
from terrafold.registry.core import TIES, grid_sql, query

CELLS = grid_sql(4)
CDF_SQL = """SELECT {c} AS cell_id, key, CAST(sum(c) OVER (PARTITION BY {c} ORDER BY key) - 1 AS BIGINT) AS rank
      FROM (SELECT {c}, y AS key, count(*) AS c FROM {t} GROUP BY 1, 2)"""
CDF = f"{CELLS}, cdf AS ({CDF_SQL.format(c='cell_id', t='cells')})"


def _cells(spark, sf):
    return core.grid_assigned(spark, sf, 4)


def _cdf(spark, sf):
    make = lambda: models.stored(models.cdf(_cells(spark, sf), n=core.ext(spark, sf).n), "cdf")
    return core.built(spark, sf, "cdf", make)


def _knots(spark, sf):
    return core.built(spark, sf, "knots", lambda: models.stored(models.fit_knots(_cdf(spark, sf)), "knots"))


@query("cdf", f"WITH {CDF} SELECT cell_id, key, rank FROM cdf")
def cdf(spark, sf):
    return models.cdf(_cells(spark, sf), n=core.ext(spark, sf).n)


@query(
    "cdf_ties",
    f"""WITH {TIES}, one AS (SELECT 0 AS cell_id, y FROM ties)
    SELECT CAST(cell_id AS INTEGER) AS cell_id, key, rank FROM ({CDF_SQL.format(c='cell_id', t='one')})""",
)
def cdf_ties(spark, sf):
    return models.cdf(core.ties(spark, sf).withColumn("cell_id", F.lit(0)))


BENDS = f"""{CDF}, near AS (
      SELECT *, lag(key) OVER w AS pk, lag(rank) OVER w AS pr, lead(key) OVER w AS nk, lead(rank) OVER w AS nr
      FROM cdf WINDOW w AS (PARTITION BY cell_id ORDER BY key)),
    knots AS (SELECT cell_id, key, rank FROM near
      WHERE pk IS NULL OR nk IS NULL OR (key - pk) * (nr - rank) <> (nk - key) * (rank - pr))"""


@query("cdf_lossless_knots", f"WITH {BENDS} SELECT cell_id, key, rank FROM knots")
def cdf_lossless_knots(spark, sf):
    return models.lossless_knots(_cdf(spark, sf), chunk=1_000)


@query(
    "cdf_slopes",
    f"""WITH {BENDS}, s AS (SELECT *, lead(key) OVER w AS next_key, lead(rank) OVER w AS next_rank
      FROM knots WINDOW w AS (PARTITION BY cell_id ORDER BY key))
    SELECT cell_id, key, rank, next_key, next_rank, round((next_rank - rank) / (next_key - key), 6) AS slope
    FROM s WHERE next_key IS NOT NULL""",
)
def cdf_slopes(spark, sf):
    out = models.segment_slopes(models.lossless_knots(_cdf(spark, sf)), chunk=1_000)
    return out.withColumn("slope", F.round("slope", 6))


@query(
    "rank_lossless",
    f"WITH {CDF} SELECT cell_id, key, rank, round(CAST(rank AS DOUBLE), 6) AS est FROM cdf",
)
def rank_lossless(spark, sf):
    """Interpolating between lossless knots gives every rank back."""
    knots = models.lossless_knots(_cdf(spark, sf))
    return models.estimate_rank(knots, _cdf(spark, sf)).withColumn("est", F.round("est", 6))


KEYS_OK = f"WITH {CDF} SELECT cell_id, count(*) AS n_keys, true AS ok FROM cdf GROUP BY cell_id"


@query("cdf_fit_error_ok", KEYS_OK)
def cdf_fit_error_ok(spark, sf):
    knots = models.fit_knots(_cdf(spark, sf), chunk=500)
    err = models.fit_error(knots, _cdf(spark, sf))
    return err.select("cell_id", "n_keys", (F.col("max_error") <= models.MAX_ERROR + 1e-6).alias("ok"))


@query("rank_estimate_ok", KEYS_OK)
def rank_estimate_ok(spark, sf):
    """Estimates between keys stay within the error bound of the ranks on both sides."""
    model = _cdf(spark, sf)
    seg = models.segment_slopes(model).select("cell_id", ((F.col("key") + F.col("next_key")) / 2).alias("key"), "rank", "next_rank")
    last = model.groupBy("cell_id").agg(F.max("key").alias("k"), F.max("rank").alias("rank"))
    asked = seg.unionByName(last.select("cell_id", (F.col("k") + 1).alias("key"), "rank", F.col("rank").alias("next_rank")))
    est = models.estimate_rank(_knots(spark, sf), asked)
    slack = models.MAX_ERROR + 1e-6
    good = (F.col("est") >= F.col("rank") - slack) & (F.col("est") <= F.col("next_rank") + slack)
    return est.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_keys"), F.bool_and(good).alias("ok"))


@query(
    "approx_range_count_ok",
    f"""WITH {CELLS}, t AS (SELECT cell_id, count(*) FILTER (y BETWEEN 500 AND 900) AS n FROM cells GROUP BY cell_id)
    SELECT cell_id, n, true AS ok FROM t""",
)
def approx_range_count_ok(spark, sf):
    est = models.approximate_range_count(_knots(spark, sf), 500.0, 900.0)
    y = F.col("y")
    true = _cells(spark, sf).groupBy("cell_id").agg(
        F.count_if(y.between(500, 900)).alias("n"), F.count_if(y == 500).alias("tied")
    )
    slack = 2 * models.MAX_ERROR + 1 + F.col("tied")
    ok = F.abs(F.col("est_n") - F.col("n")) <= slack
    return est.join(true, "cell_id").select("cell_id", "n", ok.alias("ok"))


@query("model_size_ok", KEYS_OK)
def model_size_ok(spark, sf):
    """A model never has more knots than keys."""
    size = models.model_size(_knots(spark, sf), _cdf(spark, sf))
    return size.select("cell_id", F.col("keys").alias("n_keys"), (F.col("knots") <= F.col("keys")).alias("ok"))


@query("fit_within_size_ok", KEYS_OK)
def fit_within_size_ok(spark, sf):
    model = _cdf(spark, sf)
    knots = models.fit_within_size(model, 12)
    size = models.model_size(knots, model)
    return size.select("cell_id", F.col("keys").alias("n_keys"), (F.col("knots") <= 12).alias("ok"))
