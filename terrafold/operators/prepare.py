"""Cleaning, validity report and normalisation of raw coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.values import finite
from terrafold.plans.extent import Extent


def missing(x: str = "x", y: str = "y") -> Column:
    return ~(finite(x) & finite(y))


def drop_missing(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Drop rows with a coordinate that is null, NaN or infinite."""
    return points.filter(~missing(x, y))


def drop_zero_island(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Drop rows that sit exactly on (0, 0); a single zero coordinate stays."""
    return points.filter(~((F.col(x) == 0.0) & (F.col(y) == 0.0)))


def keep_in_box(points: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    return points.filter(g.box_contains_point(*box, x, y))


def clean_points(
    points: DataFrame, box: tuple[float, float, float, float], zero_island: bool = True, x: str = "x", y: str = "y"
) -> DataFrame:
    out = drop_missing(points, x, y)
    if zero_island:
        out = drop_zero_island(out, x, y)
    return keep_in_box(out, box, x, y)


def rejection_reason(
    box: tuple[float, float, float, float], zero_island: bool = True, x: str = "x", y: str = "y"
) -> Column:
    """First failing rule of a row: missing, zero_island, out_of_box, or valid."""
    reason = F.when(missing(x, y), "missing")
    if zero_island:
        reason = reason.when((F.col(x) == 0.0) & (F.col(y) == 0.0), "zero_island")
    return reason.when(~g.box_contains_point(*box, x, y), "out_of_box").otherwise("valid")


def validity_report(
    points: DataFrame, box: tuple[float, float, float, float], zero_island: bool = True, x: str = "x", y: str = "y"
) -> DataFrame:
    """One pass, one row: raw, valid, dropped, dropped per reason, drop rate."""
    why = rejection_reason(box, zero_island, x, y)
    counted = points.select(why.alias("why")).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.col("why") == "valid").alias("n_valid"),
        F.count_if(F.col("why") == "missing").alias("n_missing"),
        F.count_if(F.col("why") == "zero_island").alias("n_zero_island"),
        F.count_if(F.col("why") == "out_of_box").alias("n_out_of_box"),
    )
    dropped = F.col("n_raw") - F.col("n_valid")
    return counted.withColumns({
        "n_dropped": dropped, "drop_rate": F.try_divide(dropped.cast("double"), F.col("n_raw").cast("double"))
    })


def minmax_normalize(points: DataFrame, ext: Extent | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Both axes to [0, 1]; a constant axis becomes 0."""
    e = ext or Extent.of(points, x, y)

    def scaled(name: str, low: float, width: float) -> Column:
        return (F.col(name) - F.lit(low)) / F.lit(width) if width > 0 else F.col(name) * 0.0

    return points.withColumns({x: scaled(x, e.min_x, e.width), y: scaled(y, e.min_y, e.height)})
