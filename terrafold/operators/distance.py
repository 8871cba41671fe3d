"""Geodesic distance query on latitude and longitude in degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.plans.pyramid import BORDER, COVERED, DISJOINT, FEW_QUERIES, PACKED_ROWS, PointIndex

JOIN_ROWS = 4_096  # points of a part that meets whole circles
COUNT_ROWS = 256  # points of a part that is tested where a circle cuts it


def distance_query(
    points: DataFrame, lat: float, lon: float, metres: float, lat_col: str = "lat", lon_col: str = "lon"
) -> DataFrame:
    """Rows within ``metres`` of a place, with their distance ``dist_m``.

    The degree boxes are plain comparisons that the scan can use; the great-circle test then decides.
    """
    boxes = [
        g.box_contains_point(lo_lat, lo_lon, hi_lat, hi_lon, lat_col, lon_col)
        for lo_lat, lo_lon, hi_lat, hi_lon in g.degree_boxes(lat, lon, metres)
    ]
    near = reduce(lambda a, b: a | b, boxes, F.lit(False))
    return (
        points.filter(near)
        .withColumn("dist_m", g.haversine_m(lat_col, lon_col, lat, lon))
        .filter(F.col("dist_m") <= F.lit(float(metres)))
    )


def _distance_pairs(index: PointIndex, places: DataFrame, key: str, settle: bool, rows: int) -> DataFrame:
    def state(box: tuple[Column, ...]) -> Column:
        near, far = g.haversine_bounds(box, "lat", "lon")
        return F.when(near > F.col("metres"), DISJOINT).when(far <= F.col("metres"), COVERED).otherwise(BORDER)

    asked = places.select(key, *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "metres")]).filter("metres >= 0").distinct()
    return index.stored(index.descend(asked, state, settle, rows=rows))


def distance_join(index: PointIndex, places: DataFrame, key: str = "qid") -> DataFrame:
    """All (place, point) pairs within the place's ``metres``, with ``dist_m``, for all places in one job.

    ``index`` holds longitude as x and latitude as y, from -180 to 180 and -90 to 90 degrees. Nodes are dropped by
    their least distance. Few places meet parts of JOIN_ROWS points, not cells, more of them larger parts, each packed in
    a row; points have no lat, lon or metres column of their own.
    """
    if places.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        reach = dict(zip(("__by_lat", "__by_lon"), g.degree_reach("lat", "metres")))
        pairs = _distance_pairs(index, places, key, settle=False, rows=PACKED_ROWS).withColumns({"__cos_place": F.cos(F.radians("lat")), **reach})
        dist = g.haversine_m("y", "x", "lat", "lon", ("__cos_point", "__cos_place"))
        # comparisons first: a point beyond the circle's box costs no great circle
        apart = F.abs(F.col("x") - F.col("lon"))
        beside = (F.abs(F.col("y") - F.col("lat")) <= F.col("__by_lat")) & ((apart <= F.col("__by_lon")) | (apart >= 360.0 - F.col("__by_lon")))
        points = index.points.withColumn("__cos_point", F.cos(F.radians("y")))
        found = index.join_part_rows(pairs, beside & (dist <= F.col("metres")), PACKED_ROWS, points)
        return found.withColumn("dist_m", dist).drop("lat", "lon", "metres", "__cos_point", "__cos_place", *reach)
    dist = g.haversine_m("y", "x", "lat", "lon")
    pairs = _distance_pairs(index, places, key, settle=False, rows=JOIN_ROWS).drop("n", "covered")
    return index.join_points(pairs, dist <= F.col("metres"), rows=JOIN_ROWS).withColumn("dist_m", dist).drop("lat", "lon", "metres")


def distance_counts(index: PointIndex, places: DataFrame, key: str = "qid") -> DataFrame:
    """Number of points within ``metres`` of every place (key unique); a node all within is settled by its count."""
    pairs = _distance_pairs(index, places, key, settle=True, rows=COUNT_ROWS)
    whole = pairs.filter("covered").select(key, "n")
    near = g.haversine_m("y", "x", "lat", "lon") <= F.col("metres")
    tested = index.join_points(pairs.filter("NOT covered").drop("n", "covered"), near, rows=COUNT_ROWS).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = whole.unionByName(tested).groupBy(key).agg(F.sum("n").alias("n"))
    return places.select(key).join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
