"""Scalar geometry as column expressions.

Every function takes columns (or column names, or numbers) and returns a ``Column`` made of built-in
expressions, so predicates stay inside whole-stage codegen and can reach the Parquet scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.values import finite, known

# Fixed values.
EARTH_RADIUS_M = 6378137.0
LOOSE_EPS = 1e-6
STRICT_EPS = 1e-9


def c(value) -> Column:
    """A column from a name, a number or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))


# ---------------------------------------------------------------- points


def point(x="x", y="y") -> Column:
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def same_point(x, y, qx, qy) -> Column:
    return (c(x) == c(qx)) & (c(y) == c(qy))


def precedes(x, y, qx, qy) -> Column:
    """Lexicographic order: x first, then y."""
    return (c(x) < c(qx)) | ((c(x) == c(qx)) & (c(y) < c(qy)))


def add_points(x, y, dx, dy) -> tuple[Column, Column]:
    return c(x) + c(dx), c(y) + c(dy)


def subtract_points(x, y, dx, dy) -> tuple[Column, Column]:
    return c(x) - c(dx), c(y) - c(dy)


def length(x, y) -> Column:
    return F.sqrt(c(x) * c(x) + c(y) * c(y))


def squared_distance(x, y, qx, qy) -> Column:
    dx, dy = c(x) - c(qx), c(y) - c(qy)
    return dx * dx + dy * dy


def distance(x, y, qx, qy) -> Column:
    return F.sqrt(squared_distance(x, y, qx, qy))


def near_point(x, y, qx, qy, eps: float | None = None, strict: bool = False) -> Column:
    """Epsilon match: a closed box of half-width eps, or with ``strict`` an open one on |dx|, |dy|."""
    if strict:
        e = STRICT_EPS if eps is None else eps
        return (F.abs(c(x) - c(qx)) < F.lit(e)) & (F.abs(c(y) - c(qy)) < F.lit(e))
    e = F.lit(LOOSE_EPS if eps is None else eps)
    return c(x).between(c(qx) - e, c(qx) + e) & c(y).between(c(qy) - e, c(qy) + e)


# ---------------------------------------------------------------- rectangles


def box_contains_point(min_x, min_y, max_x, max_y, x, y) -> Column:
    """Closed on all four sides; an inverted box contains nothing."""
    return c(x).between(c(min_x), c(max_x)) & c(y).between(c(min_y), c(max_y))


def box_contains_point_half_open(min_x, min_y, max_x, max_y, x, y) -> Column:
    """Closed on the low sides and open on the high sides, so that tiles never share a point."""
    return (c(x) >= c(min_x)) & (c(x) < c(max_x)) & (c(y) >= c(min_y)) & (c(y) < c(max_y))


def boxes_intersect(a, b) -> Column:
    """Closed intersection of two (min_x, min_y, max_x, max_y) tuples; touching counts."""
    return (c(a[0]) <= c(b[2])) & (c(a[2]) >= c(b[0])) & (c(a[1]) <= c(b[3])) & (c(a[3]) >= c(b[1]))


def box_contains_box(outer, inner) -> Column:
    return (
        (c(outer[0]) <= c(inner[0]))
        & (c(outer[1]) <= c(inner[1]))
        & (c(outer[2]) >= c(inner[2]))
        & (c(outer[3]) >= c(inner[3]))
    )


def box_area(min_x, min_y, max_x, max_y) -> Column:
    """Signed: negative when exactly one axis is inverted."""
    return (c(max_x) - c(min_x)) * (c(max_y) - c(min_y))


def box_min_distance(box, qx, qy) -> Column:
    """Distance from a point to the nearest place of a closed box (0 inside)."""
    dx = F.greatest(c(box[0]) - c(qx), F.lit(0.0), c(qx) - c(box[2]))
    dy = F.greatest(c(box[1]) - c(qy), F.lit(0.0), c(qy) - c(box[3]))
    return F.sqrt(dx * dx + dy * dy)


def box_max_distance(box, qx, qy) -> Column:
    """Distance from a point to the farthest corner of a box."""
    dx = F.greatest(F.abs(c(qx) - c(box[0])), F.abs(c(qx) - c(box[2])))
    dy = F.greatest(F.abs(c(qy) - c(box[1])), F.abs(c(qy) - c(box[3])))
    return F.sqrt(dx * dx + dy * dy)


def circle_box(cx, cy, r) -> tuple[Column, Column, Column, Column]:
    return c(cx) - c(r), c(cy) - c(r), c(cx) + c(r), c(cy) + c(r)


def in_circle(x, y, cx, cy, r) -> Column:
    """Closed disc. The box comes first because the scan can use it."""
    lo_x, lo_y, hi_x, hi_y = circle_box(cx, cy, r)
    disc = squared_distance(x, y, cx, cy) <= c(r) * c(r)
    return box_contains_point(lo_x, lo_y, hi_x, hi_y, x, y) & disc


# ---------------------------------------------------------------- polygons (ring = ARRAY<STRUCT<x, y>>)


def close_ring(ring) -> Column:
    """Append the first vertex when the ring is open."""
    r = c(ring)
    first, last = F.element_at(r, 1), F.element_at(r, -1)
    is_open = (first["x"] != last["x"]) | (first["y"] != last["y"])
    return F.when((F.size(r) > 0) & is_open, F.concat(r, F.array(first))).otherwise(r)


def ring_box(ring) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(c(ring), lambda p: p["x"]), F.transform(c(ring), lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_edges(ring) -> Column:
    """Edges of a closed ring as ARRAY<STRUCT<x1, y1, x2, y2>>."""
    r = c(ring)
    head = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))
    tail = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    return F.zip_with(
        head,
        tail,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def edge_crosses(x1, y1, x2, y2, x, y) -> Column:
    """Does a ray going right from (x, y) cross the edge? Half-open in y, so shared vertices count once."""
    x1, y1, x2, y2, x, y = map(c, (x1, y1, x2, y2, x, y))
    rise = F.nullif(y2 - y1, F.lit(0.0))
    return F.coalesce(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / rise + x1), F.lit(False))


def edges_contain(edges, x, y) -> Column:
    """Even-odd containment of a point in a polygon given by its edges."""
    return F.aggregate(
        c(edges),
        F.lit(False),
        lambda inside, e: inside != edge_crosses(e["x1"], e["y1"], e["x2"], e["y2"], c(x), c(y)),
    )


def ring_contains(ring, x, y) -> Column:
    return edges_contain(ring_edges(close_ring(ring)), x, y)


def edges_touch_box(edges, box) -> Column:
    """True when the bounding box of any edge meets the closed box: a safe test for "the border may pass here"."""
    return F.exists(
        c(edges),
        lambda e: (F.least(e["x1"], e["x2"]) <= c(box[2]))
        & (F.greatest(e["x1"], e["x2"]) >= c(box[0]))
        & (F.least(e["y1"], e["y2"]) <= c(box[3]))
        & (F.greatest(e["y1"], e["y2"]) >= c(box[1])),
    )


# ---------------------------------------------------------------- sphere


def to_radians(deg) -> Column:
    return F.radians(c(deg))


def to_degrees(rad) -> Column:
    return F.degrees(c(rad))


def haversine_m(lat1, lon1, lat2, lon2, cosines=None) -> Column:
    """Great-circle metres. The guard keeps asin in its domain for antipodal points. ``cosines`` are those of both
    latitudes, where they are at hand."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    u = F.sin((p2 - p1) / 2.0)
    v = F.sin((F.radians(c(lon2)) - F.radians(c(lon1))) / 2.0)
    cos1, cos2 = (F.cos(p1), F.cos(p2)) if cosines is None else map(c, cosines)
    h = u * u + cos1 * cos2 * v * v
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def degree_reach(lat, metres) -> tuple[Column, Column]:
    """Differences of latitude and of longitude, in degrees, that no place within ``metres`` exceeds; 180 of longitude
    where a pole is as near. Widened by far more than rounding takes off."""
    slack = 1e-5
    reach = c(metres) / F.lit(EARTH_RADIUS_M)
    by_lat = F.degrees(reach) + slack
    bounded = (F.abs(c(lat)) + by_lat < 90.0) & (reach < math.pi / 2)
    by_lon = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(reach) / F.cos(F.radians(c(lat)))))) + slack
    return by_lat, F.when(bounded, by_lon).otherwise(F.lit(180.0))


def haversine_bounds(box, lat, lon) -> tuple[Column, Column]:
    """Bounds of the great-circle metres from a place to all places of a box (min_lon, min_lat, max_lon, max_lat) in degrees.

    The haversine is a sum of a part by latitude and a part by longitude times the cosine of the other latitude. Each
    part takes its least or greatest value in the box, longitudes around the globe. Bounds are widened by a little, so
    that rounding never puts a distance outside them.
    """
    west, south, east, north = map(c, box)
    here, there = c(lat), c(lon)

    def around(a: Column) -> Column:
        """Difference of longitudes, 0 to 180."""
        return F.lit(180.0) - F.abs(F.abs(there - a) - 180.0)

    def metres(by_lat: Column, by_lon: Column, cosine: Column) -> Column:
        u, v = F.sin(F.radians(by_lat / 2)), F.sin(F.radians(by_lon / 2))
        return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(F.radians(here)) * cosine * v * v)))

    to_west, to_east = around(west), around(east)
    least = F.when(there.between(west, east), F.lit(0.0)).otherwise(F.least(to_west, to_east))
    opposite = F.when(there > 0, there - 180.0).otherwise(there + 180.0)
    most = F.when(opposite.between(west, east), F.lit(180.0)).otherwise(F.greatest(to_west, to_east))
    thin, wide = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north)))), F.cos(F.radians(F.greatest(south, -north, F.lit(0.0))))
    near = metres(F.greatest(south - here, here - north, F.lit(0.0)), least, F.greatest(thin, F.lit(0.0)))
    far = metres(F.greatest(F.abs(here - south), F.abs(here - north)), most, wide)
    return F.greatest(near * (1 - 1e-9) - 1e-2, F.lit(0.0)), far * (1 + 1e-9) + 1e-2


def degree_boxes(lat: float, lon: float, metres: float) -> list[tuple[float, float, float, float]]:
    """(min_lat, min_lon, max_lat, max_lon) boxes that together hold every place within ``metres``.

    One box normally, the full longitude range when a pole is inside, two boxes across +-180 degrees.
    """
    if metres < 0:
        return []
    slack = 1e-9
    reach = metres / EARTH_RADIUS_M
    d_lat = math.degrees(reach) + slack
    lo, hi = lat - d_lat, lat + d_lat
    if lo <= -90.0 or hi >= 90.0 or reach >= math.pi / 2:
        return [(max(lo, -90.0), -180.0, min(hi, 90.0), 180.0)]
    d_lon = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(math.radians(lat))))) + slack
    west, east = lon - d_lon, lon + d_lon
    if d_lon >= 180.0:
        return [(lo, -180.0, hi, 180.0)]
    if west < -180.0:
        return [(lo, west + 360.0, hi, 180.0), (lo, -180.0, hi, east)]
    if east > 180.0:
        return [(lo, west, hi, 180.0), (lo, -180.0, hi, east - 360.0)]
    return [(lo, west, hi, east)]


# ---------------------------------------------------------------- grids


def grid_index(value, low: float, step: float, bins: int | None = None) -> Column:
    """floor((value - low) / step); with ``bins`` the top edge folds into the last cell. Null if not finite."""
    if step <= 0.0:
        return F.when(finite(c(value)), F.lit(0))
    idx = F.floor((known(c(value)) - F.lit(low)) / F.lit(step)).cast("int")
    # least() passes over nulls
    return idx if bins is None else F.when(idx >= bins, F.lit(bins - 1)).otherwise(idx)


def expected_knn_radius(k, n, area) -> Column:
    """Radius expected to hold k of n uniform points spread over ``area``."""
    return F.sqrt(c(k) / (F.lit(math.pi) * c(n) / c(area)))


def hex_cell(x, y, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon of circumradius ``size`` holding a point.

    Fractional axial coordinates are rounded on all three cube axes; the axis with the largest rounding
    error (q before r before s on ties) is then rebuilt from the other two.
    """
    x, y = known(c(x)), known(c(y))
    fq = (F.lit(math.sqrt(3.0) / 3.0) * x - F.lit(1.0 / 3.0) * y) / F.lit(size)
    fr = F.lit(2.0 / 3.0) * y / F.lit(size)
    fs = -fq - fr
    rq, rr, rs = F.floor(fq + 0.5), F.floor(fr + 0.5), F.floor(fs + 0.5)
    eq, er, es = F.abs(rq - fq), F.abs(rr - fr), F.abs(rs - fs)
    q_worst = (eq >= er) & (eq >= es)
    q = F.when(q_worst, -rr - rs).otherwise(rq)
    r = F.when(~q_worst & (er >= es), -rq - rs).otherwise(rr)
    return q.cast("bigint"), r.cast("bigint")


def hex_center(q, r, size: float) -> tuple[Column, Column]:
    q, r = c(q), c(r)
    return (
        F.lit(size * math.sqrt(3.0)) * (q + r / F.lit(2.0)),
        F.lit(size * 1.5) * r,
    )
