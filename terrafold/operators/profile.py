"""Distribution profiles: statistics, densities, histograms, quantiles, ECDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.plans.extent import Extent
from terrafold.plans.ordering import exact_quantiles, running_total


def axis_statistics(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Rows (axis, n, mean, std, min, max); std is the sample standard deviation. One pass for all axes."""
    stats = ("n", "mean", "std", "min", "max")
    makers = (F.count, F.avg, F.stddev_samp, F.min, F.max)
    wide = points.agg(*[make(a).alias(f"{a}_{s}") for a in axes for s, make in zip(stats, makers)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("axis"), *[F.col(f"{a}_{s}").alias(s) for s in stats]) for a in axes
    ])
    return wide.select(F.inline(rows))


def _grid_cells(spark, bins_x: int, bins_y: int) -> DataFrame:
    """Every cell of a grid, whose size is a parameter."""
    ids = spark.range(bins_x * bins_y)
    return ids.select((F.col("id") % bins_x).cast("int").alias("cx"), F.floor(F.col("id") / bins_x).cast("int").alias("cy"))


def grid_density(
    points: DataFrame, bins: int = 20, ext: Extent | None = None, bins_y: int | None = None
) -> DataFrame:
    """Count per cell of a bins x bins grid over the extent, empty cells included: (cx, cy, n)."""
    e = ext or Extent.of(points)
    by = bins_y or bins
    cells = (
        points.select(
            g.grid_index("x", e.min_x, e.width / bins, bins).alias("cx"),
            g.grid_index("y", e.min_y, e.height / by, by).alias("cy"),
        )
        .groupBy("cx", "cy")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = _grid_cells(points.sparkSession, bins, by)
    return every.join(cells, ["cx", "cy"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def density_skew(density: DataFrame) -> DataFrame:
    """One row from cell counts: cells, empty share, average, maximum, max / average."""
    out = density.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("n") == 0).alias("empty_cells"),
        F.avg("n").alias("avg_n"),
        F.max("n").alias("max_n"),
    )
    return out.withColumns({
        "empty_share": F.try_divide(F.col("empty_cells").cast("double"), F.col("cells").cast("double")),
        "skew": F.try_divide(F.col("max_n").cast("double"), F.col("avg_n")),
    })


def heatmap(points: DataFrame, bins: int, ext: Extent | None = None) -> DataFrame:
    """Grid density with a logarithmic column, log1p(n)."""
    return grid_density(points, bins, ext).withColumn("log_n", F.log1p("n"))


def hexbin(points: DataFrame, size: float, x="x", y="y") -> DataFrame:
    """Count per pointy-top hexagon: (q, r, n, center_x, center_y)."""
    q, r = g.hex_cell(x, y, size)
    counts = points.select(q.alias("q"), r.alias("r")).filter("q IS NOT NULL").groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"))
    cx, cy = g.hex_center("q", "r", size)
    return counts.withColumns({"center_x": cx, "center_y": cy})


def histogram(points: DataFrame, axis: str, bins: int, low: float, high: float) -> DataFrame:
    """Fixed-width bins over [low, high], right edge closed in the last bin, empty bins included."""
    width = (high - low) / bins
    counts = (
        points.filter(F.col(axis).between(low, high))
        .select(g.grid_index(axis, low, width, bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def ecdf(points: DataFrame, axis: str, n: int | None = None) -> DataFrame:
    """Rows (value, n_le, cdf) per distinct value, with range-wise prefix sums instead of one big window."""
    total = points.count() if n is None else n
    counts = points.groupBy(F.col(axis).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    run = running_total(counts, ["value"], F.col("c"), "n_le", n=total)
    share = F.col("n_le") / F.lit(float(max(total, 1)))
    return run.select("value", F.col("n_le").cast("bigint").alias("n_le"), share.alias("cdf"))


def quantile_profile(points: DataFrame, axis: str, n: int | None = None) -> DataFrame:
    """One row: q1, median, q3, 1.5 IQR fences and the number of outliers, all exact."""
    q = exact_quantiles(points, axis, [0.25, 0.5, 0.75], n=n)
    row = {r["prob"]: r["value"] for r in q.collect()}  # three rows
    q1, q2, q3 = row.get(0.25), row.get(0.5), row.get(0.75)
    if q1 is None:
        q1 = q2 = q3 = float("nan")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    v = F.col(axis)
    return points.agg(
        *[F.lit(value).alias(name) for name, value in
          (("q1", q1), ("median", q2), ("q3", q3), ("low_fence", low), ("high_fence", high))],
        F.count_if((v < low) | (v > high)).alias("n_outliers"),
    )


def approximate_quantiles(points: DataFrame, axis: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """One row with an array: a mergeable sketch, for when exact values are not needed."""
    marks = F.array(*[F.lit(p) for p in probs])
    return points.agg(F.percentile_approx(axis, marks, F.lit(accuracy)).alias("quantiles"))
