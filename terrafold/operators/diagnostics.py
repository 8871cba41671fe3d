"""Partition quality: per-cell counts and boxes, balance, histogram, loss, run-time summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.plans.ordering import number_rows
from terrafold.plans.pyramid import box_aggregates
from terrafold.plans.session import written

# Fixed value: cells up to this many points count as small.
SMALL_CELL = 100


def cells_table(assigned: DataFrame, key: str = "cell_id") -> DataFrame:
    """Count, bounding box, area and degenerate flag per cell, in one pass."""
    cells = assigned.groupBy(key).agg(*box_aggregates())
    return cells.withColumns({
        "area": F.greatest(F.lit(0.0), g.box_area("min_x", "min_y", "max_x", "max_y")),
        "single_location": (F.col("min_x") == F.col("max_x")) & (F.col("min_y") == F.col("max_y")),
    })


def cell_counts(assigned: DataFrame, key: str = "cell_id") -> DataFrame:
    return assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _all_cells(cells: DataFrame, partitions: int, key: str) -> DataFrame:
    """Cells 0..partitions-1 with n and area 0 where empty."""
    every = cells.sparkSession.range(partitions).select(F.col("id").cast("int").alias(key))
    joined = every.join(cells.select(key, "n", "area"), key, "left")
    return joined.withColumns({"n": F.coalesce("n", F.lit(0)), "area": F.coalesce("area", F.lit(0.0))})


def partition_balance(cells: DataFrame, partitions: int, key: str = "cell_id") -> DataFrame:
    """One row: min / avg / max points and areas over all partitions, empty ones included."""
    return _all_cells(cells, partitions, key).agg(
        F.count(F.lit(1)).alias("partitions"),
        F.min("n").alias("min_n"),
        F.avg("n").alias("avg_n"),
        F.max("n").alias("max_n"),
        F.count_if(F.col("n") == 0).alias("empty"),
        F.min("area").alias("min_area"),
        F.avg("area").alias("avg_area"),
        F.max("area").alias("max_area"),
    )


def size_histogram(cells: DataFrame, partitions: int, key: str = "cell_id") -> DataFrame:
    """Cells per size class; all five classes are always present."""
    n = F.col("n")
    bucket = (
        F.when(n == 0, 0).when(n <= 100, 1).when(n <= 1_000, 2).when(n <= 10_000, 3).otherwise(4)
    )
    found = _all_cells(cells, partitions, key).groupBy(bucket.alias("k")).agg(F.count(F.lit(1)).alias("cells"))
    # The size classes of the report.
    labels = ("0", "1-100", "101-1000", "1001-10000", ">10000")
    names = cells.sparkSession.createDataFrame(list(enumerate(labels)), "k int, bucket string")
    return names.join(found, "k", "left").select("bucket", F.coalesce("cells", F.lit(0)).cast("bigint").alias("cells"))


def small_cell_ratio(cells: DataFrame, threshold: int = SMALL_CELL) -> DataFrame:
    """Share of non-empty cells that hold at most ``threshold`` points; 0 when there are none."""
    out = cells.agg(
        F.count_if(F.col("n") > 0).alias("non_empty"), F.count_if(F.col("n").between(1, threshold)).alias("small")
    )
    ratio = F.coalesce(F.try_divide(F.col("small").cast("double"), F.col("non_empty").cast("double")), F.lit(0.0))
    return out.withColumn("ratio", ratio)


def loss_check(points: DataFrame, assigned: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows before and after cell assignment; rows without a cell count as lost, rows in cell -1 as unplaced."""
    unplaced = F.count_if(F.col(key).cast("string") == "-1")
    after = assigned.agg(F.struct(F.count(key).alias("n"), unplaced.alias("u")).alias("after")).scalar()
    counted = points.agg(F.count(F.lit(1)).alias("n_before")).withColumn("__a", after)
    counted = counted.withColumns({"n_after": F.col("__a.n"), "n_unplaced": F.col("__a.u")}).drop("__a")
    return counted.withColumn("n_lost", F.col("n_before") - F.col("n_after"))


def report(points: DataFrame, assigned: DataFrame, method: str, partitions: int, label: str = "") -> DataFrame:
    """The whole diagnostics as one row, ready for ``append_report``.

    The assigned points are read once: everything else comes from the stored cells table.
    """
    cells = written(cells_table(assigned), "report-cells")
    placed = cells.filter(F.col("cell_id").isNotNull())
    n_before, n_after = points.agg(F.count(F.lit(1))).scalar(), F.coalesce(placed.agg(F.sum("n")).scalar(), F.lit(0))
    classes = size_histogram(placed, partitions).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cells"))))
    small = small_cell_ratio(placed)
    return partition_balance(placed, partitions).withColumns({
        "method": F.lit(method),
        "label": F.lit(label),
        "reported_at": F.current_timestamp(),
        "n_before": n_before,
        "n_after": n_after,
        "n_lost": n_before - n_after,
        "histogram": classes.scalar(),
        "non_empty": small.select("non_empty").scalar(),
        "small": small.select("small").scalar(),
        "small_ratio": small.select("ratio").scalar(),
    })


def pruning_report(cells: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """How many cells and rows a window can touch."""
    hit = g.boxes_intersect(window, ("min_x", "min_y", "max_x", "max_y"))
    out = cells.agg(
        F.count(F.lit(1)).alias("cells_total"),
        F.count_if(hit).alias("cells_hit"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_hit"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_total"),
    )
    share = F.coalesce(F.try_divide(F.col("rows_hit").cast("double"), F.col("rows_total").cast("double")), F.lit(0.0))
    return out.withColumn("row_share", share)


# ---------------------------------------------------------------- run times


def runtime_summary(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, avg, min, max, population and sample deviation, rank from fast to slow."""
    v = F.col(value)
    stats = runs.groupBy(group).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("avg"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_pop(v).alias("std_pop"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_samp"),
    )
    ranked = number_rows(stats, ["avg", group], "rank")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))


def speedup(runs: DataFrame, query: str, variant: str, value: str, base: str, test: str) -> DataFrame:
    """avg(base) / avg(test) per query; null when the denominator is missing or zero."""
    v = F.col(value)
    out = runs.groupBy(query).agg(
        F.avg(F.when(F.col(variant) == base, v)).alias("base_avg"),
        F.avg(F.when(F.col(variant) == test, v)).alias("test_avg"),
    )
    return out.withColumn("speedup", F.try_divide("base_avg", "test_avg"))
