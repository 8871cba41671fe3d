"""Scalar geometry over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.plans.ordering import number_rows
from terrafold.registry import core
from terrafold.registry.core import EXT, GEO, POLYS, PTS, WINDOWS, query
from terrafold.sources.readers import rings_from_vertices


def r6(c):
    return F.round(c, 6)


@query(
    "point_functions",
    f"""WITH {EXT} SELECT id, x + 10 AS plus_x, y + 20 AS plus_y, x - 10 AS minus_x, y - 20 AS minus_y,
      round(sqrt(x * x + y * y), 6) AS length, round((x - 1000) * (x - 1000) + (y - 5) * (y - 5), 2) AS d2,
      round(sqrt((x - 1000) * (x - 1000) + (y - 5) * (y - 5)), 6) AS dist,
      x = x0 AND y = y0 AS at_corner, x < 250000 OR (x = 250000 AND y < 1200) AS before_mid,
      x >= 1000 AND x < 250000 AND y >= 0 AND y < 1200 AS in_half_open,
      CAST(floor((x - x0) / ((x1 - x0) / 1000)) AS INTEGER) AS slot
    FROM pts CROSS JOIN ext""",
)
def point_functions(spark, sf):
    e = core.ext(spark, sf)
    px, py = g.add_points("x", "y", 10, 20)
    mx, my = g.subtract_points("x", "y", 10, 20)
    return core.pts(spark, sf).select(
        "id",
        px.alias("plus_x"),
        py.alias("plus_y"),
        mx.alias("minus_x"),
        my.alias("minus_y"),
        r6(g.length("x", "y")).alias("length"),
        F.round(g.squared_distance("x", "y", 1000, 5), 2).alias("d2"),
        r6(g.distance("x", "y", 1000, 5)).alias("dist"),
        g.same_point("x", "y", e.min_x, e.min_y).alias("at_corner"),
        g.precedes("x", "y", 250000, 1200).alias("before_mid"),
        g.box_contains_point_half_open(1000, 0, 250000, 1200, "x", "y").alias("in_half_open"),
        g.grid_index("x", e.min_x, e.width / 1000).alias("slot"),
    )


@query(
    "box_functions",
    f"""WITH {WINDOWS} SELECT qid, (max_x - min_x) * (max_y - min_y) AS area,
      min_x <= 150000 AND max_x >= 100000 AND min_y <= 900 AND max_y >= 500 AS meets,
      min_x <= 120000 AND max_x >= 121000 AND min_y <= 700 AND max_y >= 701 AS holds_box,
      120000 BETWEEN min_x AND max_x AND 700 BETWEEN min_y AND max_y AS holds_point,
      min_x - max_y AS circle_min_x, min_y - max_y AS circle_min_y, min_x + max_y AS circle_max_x, min_y + max_y AS circle_max_y,
      round(sqrt(10 / (CAST(pi() AS DOUBLE) * 1000 / ((max_x - min_x) * (max_y - min_y)))), 6) AS knn_radius
    FROM windows""",
)
def box_functions(spark, sf):
    w = ("min_x", "min_y", "max_x", "max_y")
    circle = g.circle_box("min_x", "min_y", "max_y")
    return core.windows(spark, sf).select(
        "qid",
        g.box_area(*w).alias("area"),
        g.boxes_intersect(w, (100000, 500, 150000, 900)).alias("meets"),
        g.box_contains_box(w, (120000, 700, 121000, 701)).alias("holds_box"),
        g.box_contains_point(*w, 120000, 700).alias("holds_point"),
        *[b.alias(f"circle_{n}") for b, n in zip(circle, w)],
        r6(g.expected_knn_radius(10, 1000, g.box_area(*w))).alias("knn_radius"),
    )


@query(
    "polygon_functions",
    f"""WITH {POLYS} SELECT v.poly_id, CAST(6 AS INTEGER) AS closed_size, min_x, min_y, max_x, max_y,
      (SELECT count(*) % 2 = 1 FROM edges e WHERE e.poly_id = v.poly_id AND ((e.y1 > cy - 60) <> (e.y2 > cy - 60))
        AND cx < (e.x2 - e.x1) * (cy - 60 - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1) AS holds_low,
      (SELECT count(*) % 2 = 1 FROM edges e WHERE e.poly_id = v.poly_id AND ((e.y1 > cy + 60) <> (e.y2 > cy + 60))
        AND cx < (e.x2 - e.x1) * (cy + 60 - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1) AS holds_notch
    FROM (SELECT poly_id, min_x, min_y, max_x, max_y, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy FROM envelopes) v""",
)
def polygon_functions(spark, sf):
    box = ("min_x", "min_y", "max_x", "max_y")
    shapes = rings_from_vertices(core.vertices(spark, sf))
    boxed = shapes.select("poly_id", "ring", *[b.alias(n) for b, n in zip(g.ring_box("ring"), box)])
    mid = boxed.withColumns({"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2})
    return mid.select(
        "poly_id",
        F.size(g.close_ring("ring")).alias("closed_size"),
        *box,
        g.ring_contains("ring", "cx", F.col("cy") - 60).alias("holds_low"),
        g.ring_contains("ring", "cx", F.col("cy") + 60).alias("holds_notch"),
    )


@query(
    "sphere_functions",
    f"""WITH {GEO} SELECT id, round(radians(lat), 9) AS rad, round(degrees(radians(lon)), 6) AS deg,
      round(2 * CAST(6378137 AS DOUBLE) * asin(least(1.0, sqrt(pow(sin((radians(40.0) - radians(lat)) / 2), 2)
        + cos(radians(lat)) * cos(radians(40.0)) * pow(sin((radians(-75.0) - radians(lon)) / 2), 2)))), 3) AS dist_m FROM geo""",
)
def sphere_functions(spark, sf):
    return core.geo(spark, sf).select(
        "id",
        F.round(g.to_radians("lat"), 9).alias("rad"),
        r6(g.to_degrees(g.to_radians("lon"))).alias("deg"),
        F.round(g.haversine_m("lat", "lon", 40.0, -75.0), 3).alias("dist_m"),
    )


@query(
    "lexicographic_first",
    f"WITH {PTS} SELECT id, x, y, row_number() OVER (ORDER BY x, y, id) - 1 AS position FROM pts",
)
def lexicographic_first(spark, sf):
    """Every row with its place in the order, without a window over the whole table."""
    return number_rows(core.pts(spark, sf), ["x", "y", "id"], "position")
