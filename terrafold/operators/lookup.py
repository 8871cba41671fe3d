"""Point, window and circle queries on any point table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.plans.pyramid import BORDER, DISJOINT, PointIndex
from terrafold.plans.session import bounded_broadcast, written


def point_lookup(points: DataFrame, qx: float, qy: float, distinct: bool = False) -> DataFrame:
    """All rows at exactly this place; ``distinct`` keeps the one with the smallest id."""
    hits = points.filter(g.same_point("x", "y", qx, qy))
    return hits.orderBy("id").limit(1) if distinct else hits


def point_exists(points: DataFrame, qx: float, qy: float) -> DataFrame:
    """One row, ``found``; the limit lets the scan stop at the first hit."""
    hit = points.filter(g.same_point("x", "y", qx, qy)).select(F.lit(1).alias("one")).limit(1)
    return hit.agg((F.count("one") > 0).alias("found"))


def points_exist(points: DataFrame, probes: DataFrame, key: str = "qid") -> DataFrame:
    """Batch form: probes (key, qx, qy) with a ``found`` flag.

    Probed places are made distinct first; points keep only what lies at one of them, before anything of theirs is
    shuffled while the places are few; then the places found are distinct, so nothing multiplies.
    """
    asked = written(probes.select(F.col("qx").alias("__px"), F.col("qy").alias("__py")).distinct(), "probed-places")
    return _flagged(points, bounded_broadcast(asked, asked.count()), probes)


def indexed_points_exist(index: PointIndex, probes: DataFrame, key: str = "qid") -> DataFrame:
    """``points_exist`` over an index: probed places walk the pyramid, and only the folders of their cells are read."""
    asked = probes.select(F.col("qx").alias("__px"), F.col("qy").alias("__py")).distinct()
    box = (F.col("__px"), F.col("__py"), F.col("__px"), F.col("__py"))
    pairs = index.stored(index.descend(asked, lambda node: F.when(g.boxes_intersect(box, node), BORDER).otherwise(DISJOINT), settle=False))
    here = index.join_points(pairs, g.same_point("x", "y", "__px", "__py"))
    return _with_flag(here.select(F.col("__px").alias("__x"), F.col("__py").alias("__y")), probes)


def _flagged(points: DataFrame, asked: DataFrame, probes: DataFrame) -> DataFrame:
    hits = points.select(F.col("x").alias("__x"), F.col("y").alias("__y")).join(asked, g.same_point("__x", "__y", "__px", "__py"), "left_semi")
    return _with_flag(hits, probes)


def _with_flag(hits: DataFrame, probes: DataFrame) -> DataFrame:
    places = hits.distinct().withColumn("found", F.lit(True))
    joined = probes.join(places, g.same_point("__x", "__y", "qx", "qy"), "left").drop("__x", "__y")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def point_lookup_eps(
    points: DataFrame, qx: float, qy: float, eps: float | None = None, strict: bool = False
) -> DataFrame:
    return points.filter(g.near_point("x", "y", qx, qy, eps, strict))


def range_query(points: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """Rows in a closed window; inverted windows are empty."""
    return points.filter(g.box_contains_point(*window, "x", "y"))


def range_count(points: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    return range_query(points, window).agg(F.count(F.lit(1)).alias("n"))


def circle_query(points: DataFrame, cx: float, cy: float, r: float) -> DataFrame:
    """Rows in a closed disc; a negative radius is empty."""
    inside = g.in_circle("x", "y", cx, cy, r) if r >= 0 else F.lit(False)
    return points.filter(inside)


def circle_count(points: DataFrame, cx: float, cy: float, r: float) -> DataFrame:
    return circle_query(points, cx, cy, r).agg(F.count(F.lit(1)).alias("n"))


def sort_by_y(points: DataFrame) -> DataFrame:
    """Total order (y, x, id); range partitioning sees all three keys, so runs of equal y are spread."""
    return points.orderBy("y", "x", "id")


def sort_within_cells(assigned: DataFrame) -> DataFrame:
    return assigned.sortWithinPartitions("cell_id", "y", "x", "id")
