"""Batch joins of points with windows and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.values import finite
from terrafold.operators.crossings import count_crossings
from terrafold.operators.ranges import PART_ROWS, WINDOW, count_in_parts
from terrafold.plans.ordering import add_buckets
from terrafold.plans.pyramid import BORDER, BOX, COVERED, DISJOINT, FEW_QUERIES, PACKED_ROWS, PointIndex
from terrafold.plans.session import bounded_broadcast, written

SLAB_ROWS = 262_144  # points, and edges, of one task of a slab
JOIN_ROWS = 4_096  # points of a part that meets whole windows: few pairs beside the rows that come of them


def _named_windows(windows: DataFrame, key: str) -> DataFrame:
    return windows.select(F.col(key), *[F.col(b).alias(w) for b, w in zip(BOX, WINDOW)])


def _window_pairs(index: PointIndex, windows: DataFrame, key: str, settle: bool, rows: int | None = None) -> DataFrame:
    proper = (F.col(WINDOW[0]) <= F.col(WINDOW[2])) & (F.col(WINDOW[1]) <= F.col(WINDOW[3]))

    def state(box) -> Column:
        return (
            F.when(~g.boxes_intersect(WINDOW, box), DISJOINT)
            .when(g.box_contains_box(WINDOW, box), COVERED)
            .otherwise(BORDER)
        )

    # a window listed twice under one key is one window
    return index.stored(index.descend(_named_windows(windows, key).filter(proper).distinct(), state, settle, rows=rows))


def window_join(
    index: PointIndex, windows: DataFrame, key: str = "qid", rows: int | None = None, points: DataFrame | None = None
) -> DataFrame:
    """All (window key, point) pairs with the point in the closed window.

    Windows meet parts of ``rows`` points, not cells: there are many rows of the result to a pair. Without ``rows``, a
    batch of more than FEW_QUERIES windows meets larger parts, each packed in a row. ``points`` may be some of the stored
    points."""
    inside = g.box_contains_point(*WINDOW, "x", "y")
    if rows is None and windows.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        pairs = _window_pairs(index, windows, key, settle=False, rows=PACKED_ROWS)
        return index.join_part_rows(pairs, inside, PACKED_ROWS, points).drop(*WINDOW)
    rows = rows or JOIN_ROWS
    pairs = _window_pairs(index, windows, key, settle=False, rows=rows)
    return index.join_points(pairs, F.col("covered") | inside, points=points, rows=rows).drop(*WINDOW, "covered", "n")


def _found(index: PointIndex, pairs: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Rows (keys, n): whole nodes count from the pyramid, border cells from their points."""
    whole = pairs.filter("covered").select(*keys, F.col("n").alias("n"))
    border = index.join_points(pairs.filter(~F.col("covered")).drop("n"), inside)
    tested = border.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(tested).groupBy(*keys).agg(F.sum("n").alias("n"))


def _or_zero(n: str = "n") -> Column:
    return F.coalesce(n, F.lit(0)).cast("bigint")


def window_counts(index: PointIndex, windows: DataFrame, key: str = "qid") -> DataFrame:
    """Number of points per window, for all windows in one job; empty windows stay with 0.

    Every row of ``windows`` gets the count of its own box, also where rows repeat a key. Whole nodes count from the
    pyramid. The points of a part that windows cut are ranked once for all of these, so no window tests points."""
    pairs, keys = _window_pairs(index, windows, key, settle=True, rows=PART_ROWS), [key, *WINDOW]
    whole = pairs.filter("covered").select(*keys, F.col("n").alias("n"))
    tested = count_in_parts(index, pairs.filter(~F.col("covered")), keys, PART_ROWS)
    found = whole.unionByName(tested).groupBy(*keys).agg(F.sum("n").alias("n"))
    named = found.withColumnsRenamed(dict(zip(WINDOW, BOX)))
    return windows.drop("n").join(named, [key, *BOX], "left").select(*[c for c in windows.columns if c != "n"], _or_zero().alias("n"))


def window_selectivity(index: PointIndex, windows: DataFrame, key: str = "qid") -> DataFrame:
    """``window_counts`` plus the share of all points."""
    share = F.col("n") / F.nullif(F.lit(float(index.extent.n)), F.lit(0.0))
    return window_counts(index, windows, key).withColumn("selectivity", share)


# ---------------------------------------------------------------- polygons (poly_id, ring)


def polygon_envelopes(polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    box = g.ring_box("ring")
    return polygons.select(key, *[b.alias(name) for b, name in zip(box, BOX)])


def envelope_join(index: PointIndex, polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    return window_join(index, polygon_envelopes(polygons, key), key)


def envelope_counts(index: PointIndex, polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    return window_counts(index, polygon_envelopes(polygons, key), key).select(key, "n")


def nested_points(pairs: DataFrame, key: str = "poly_id", id_col: str = "id", ids_per_list: int = 10_000) -> DataFrame:
    """Point ids per polygon as sorted lists.

    Ids are unique, so cutting them at multiples of ``ids_per_list`` bounds every list however many points a
    polygon holds; together the lists of a polygon are its whole result.
    """
    part = F.floor(F.col(id_col) / F.lit(ids_per_list)).cast("bigint").alias("part")
    return pairs.groupBy(key, part).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(id_col)).alias("ids")
    )


def _polygon_pairs(index: PointIndex, polygons: DataFrame, key: str, settle: bool) -> DataFrame:
    edges = g.ring_edges(g.close_ring("ring"))
    sides = polygons.select(key, edges.alias("edges"), *[b.alias(w) for b, w in zip(g.ring_box("ring"), WINDOW)])

    def state(box) -> Column:
        # no edge near the node's box: all of it is on one side, and one corner tells which
        return (
            F.when(~g.boxes_intersect(WINDOW, box), DISJOINT)
            .when(g.edges_touch_box("edges", box), BORDER)
            .when(g.edges_contain("edges", box[0], box[1]), COVERED)
            .otherwise(DISJOINT)
        )

    def near(box) -> Column:
        # a ray going right from a point of the box meets no other edge
        return F.filter(
            "edges",
            lambda e: (F.least(e["y1"], e["y2"]) <= box[3])
            & (F.greatest(e["y1"], e["y2"]) >= box[1])
            & (F.greatest(e["x1"], e["x2"]) >= box[0]),
        )

    return index.stored(index.descend(sides, state, settle, {"edges": near}))


def _in_polygon() -> Column:
    return F.col("covered") | (g.box_contains_point(*WINDOW, "x", "y") & g.edges_contain("edges", "x", "y"))


def polygon_join(index: PointIndex, polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """All (polygon, point) pairs with the point inside by the even-odd rule."""
    joined = index.join_points(_polygon_pairs(index, polygons, key, settle=False), _in_polygon())
    return joined.drop(*WINDOW, "edges", "covered", "n")


def polygon_counts(index: PointIndex, polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    pairs = _polygon_pairs(index, polygons, key, settle=True)
    found = _found(index, pairs, [key], _in_polygon())
    return polygons.select(key).join(found, key, "left").withColumn("n", _or_zero())


def edge_slabs(index: PointIndex, edges: DataFrame, key: str = "poly_id") -> DataFrame:
    """Edges (poly_id, x1, y1, x2, y2) cut at the y cuts of the rank grid: a row per slab ``by`` that an edge enters,
    with the x buckets ``c0`` to ``c1`` that it covers and ``spans``, whether it goes through the whole slab.

    Level edges and edges with missing ends cross no ray and are left out."""
    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    ends = edges.select(key, "x1", "y1", "x2", "y2").filter(F.col("y1") != F.col("y2")).withColumns({
        "__lx": low("x1", "x2"), "__hx": high("x1", "x2"), "__ly": low("y1", "y2"), "__hy": high("y1", "y2")
    })
    grid = index.grid.base
    placed = add_buckets(ends, c0=("__lx", grid.x), c1=("__hx", grid.x), s0=("__ly", grid.y), s1=("__hy", grid.y))
    slabs = placed.withColumn("by", F.explode(F.sequence("s0", "s1")))
    return slabs.withColumn("spans", (F.col("by") > F.col("s0")) & (F.col("by") < F.col("s1"))).drop("__lx", "__hx", "__ly", "__hy", "s0", "s1")


def polygon_join_by_edges(index: PointIndex, edges: DataFrame, key: str = "poly_id") -> DataFrame:
    """The same pairs from an edges table (poly_id, x1, y1, x2, y2), for polygons with very many edges.

    A ray going right from a point can only cross edges of its slab, so points and edges meet on (polygon, slab), in
    tasks of at most SLAB_ROWS points and SLAB_ROWS edges. There the points are cut again into thin layers by y: of an
    edge that goes through a whole layer, the ends of its run inside the layer tell for all points but those between
    them whether it is crossed. The rule is the one of ``geometry.edge_crosses``, number for number.
    """
    boxes = edges.groupBy(key).agg(
        F.min(F.least("x1", "x2")).alias("min_x"),
        F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"),
        F.max(F.greatest("y1", "y2")).alias("max_y"),
    )
    candidates = window_join(index, boxes, key).select(key, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    candidates = written(index.grid.base.add(candidates), "edge-candidates")
    slabs = written(edge_slabs(index, edges, key).filter(finite("x1") & finite("x2")), "edge-slabs")

    def deals(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key, "by").agg(F.ceil(F.count(F.lit(1)) / SLAB_ROWS).cast("int").alias(name))

    dealt = written(deals(candidates, "__p").join(deals(slabs, "__e"), [key, "by"]), "slab-deals")
    n = dealt.count()

    def deal(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.join(bounded_broadcast(dealt, n), [key, "by"])
        placed = placed.withColumn(own, F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    group = [key, "by", "__p", "__e"]
    points = deal(candidates.drop("bx"), "__p", "__e").groupBy(*group)
    sides = deal(slabs.select(key, "by", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), "__e", "__p")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = f"`{key}` {kinds[key]}, id {kinds['id']}, x double, y double, c bigint"
    crossed = points.cogroup(sides.groupBy(*group)).applyInArrow(count_crossings(key, max(256, math.isqrt(index.extent.n))), schema)
    odd = crossed.groupBy(key, "id").agg(F.sum("c").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"))
    return odd.filter(F.col("c") % 2 == 1).drop("c")


def points_in_any_polygon(index: PointIndex, polygons: DataFrame) -> DataFrame:
    """Semi join: every point that lies in at least one polygon, once."""
    return _by_membership(index, polygons, "left_semi")


def points_in_no_polygon(index: PointIndex, polygons: DataFrame) -> DataFrame:
    """Anti join: every point that lies in no polygon."""
    return _by_membership(index, polygons, "left_anti")


def _by_membership(index: PointIndex, polygons: DataFrame, how: str) -> DataFrame:
    pairs = _polygon_pairs(index, polygons, "poly_id", settle=False).drop("poly_id", "n")
    return index.join_points(pairs, _in_polygon(), how)
