"""Samples, random query points and query windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.plans.extent import Extent

# Selectivity levels of the window sweep.
SELECTIVITY_LEVELS = (1e-7, 1e-6, 1e-5, 1e-4, 1e-3)


def sample_points(points: DataFrame, n: int, seed: int = 42, id_col: str = "id", rank: Column | None = None) -> DataFrame:
    """n points in hash order of their id: the same sample whatever the partitioning. A top-n, not a full sort."""
    key = F.xxhash64(F.col(id_col), F.lit(seed)) if rank is None else rank
    return points.orderBy(key, id_col).limit(n)


def sample_fraction(points: DataFrame, fraction: float, seed: int) -> DataFrame:
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    return points.sample(False, fraction, seed)


def random_points(spark: SparkSession, ext: Extent, n: int, seed: int = 42) -> DataFrame:
    """n uniform points (qid, qx, qy) in a bounding box."""
    return spark.range(n).select(
        F.col("id").alias("qid"),
        (F.lit(ext.min_x) + F.rand(seed) * F.lit(ext.width)).alias("qx"),
        (F.lit(ext.min_y) + F.rand(seed + 1) * F.lit(ext.height)).alias("qy"),
    )


def windows_around(centers: DataFrame, half_x, half_y=None, x: str = "qx", y: str = "qy") -> DataFrame:
    """Windows [c - h, c + h] around points; half widths are numbers or columns."""
    hx = half_x if isinstance(half_x, Column) else F.lit(float(half_x))
    hy = hx if half_y is None else half_y if isinstance(half_y, Column) else F.lit(float(half_y))
    return centers.withColumns({
        "min_x": F.col(x) - hx, "min_y": F.col(y) - hy, "max_x": F.col(x) + hx, "max_y": F.col(y) + hy
    })


def selectivity_windows(
    centers: DataFrame, area: float, levels: tuple[float, ...] = SELECTIVITY_LEVELS, x: str = "qx", y: str = "qy"
) -> DataFrame:
    """Square windows of area level * area around every centre, one row per level (0-based ``lvl``)."""
    sides = [F.struct(F.lit(i).alias("lvl"), F.lit(s).alias("selectivity_target"), F.lit(math.sqrt(s * area) / 2).alias("half"))
             for i, s in enumerate(levels)]
    rows = centers.withColumn("l", F.explode(F.array(*sides))).select("*", "l.*").drop("l")
    return windows_around(rows, F.col("half"), x=x, y=y).drop("half")
