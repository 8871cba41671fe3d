"""Exact k-nearest-neighbour queries. Order is always (distance, x, y, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators.prepare import drop_missing
from terrafold.operators.ranges import WINDOW
from terrafold.plans.pyramid import BOX, NODE, PointIndex


def _positive(k: int) -> int:
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    return k


def knn(points: DataFrame, qx: float, qy: float, k: int) -> DataFrame:
    """The k nearest points of one place: per-task heaps merged by a top-k node."""
    placed = drop_missing(points).withColumn("dist", g.distance("x", "y", qx, qy))
    return placed.orderBy("dist", "x", "y", "id").limit(_positive(k))


def cells_within_reach(cells: DataFrame, k: int) -> DataFrame:
    """Cells (cell_id, n, near, far) that can hold one of the k nearest points of one place.

    The order runs over the cells table only, whose size is a layout parameter.
    """
    by_far = Window.partitionBy(F.lit(0)).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.min(F.when(F.col("held") >= _positive(k), F.col("far"))).over(Window.partitionBy(F.lit(0)))
    held = cells.withColumn("held", F.sum("n").over(by_far)).withColumn("reach", reach)
    return held.filter(F.col("near") <= F.coalesce("reach", F.lit(float("inf")))).select("cell_id", "n")


def topk_refine(candidates: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """The k best candidates per query with an ascending rank. Spark limits groups before the shuffle."""
    order = Window.partitionBy(key).orderBy("dist", "x", "y", "id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= _positive(k))


def few_of_each_place(index: PointIndex, k: int) -> DataFrame:
    """The stored points; of a split cell that is one place only the k smallest ids, which are all that can be among
    the k nearest, since its points differ only by id."""
    ordinary, single = index.split_single_locations()
    if single is None:
        return ordinary
    per_place = Window.partitionBy(NODE, "bx", "by").orderBy("id")
    return ordinary.unionByName(single.withColumn("__r", F.row_number().over(per_place)).filter(F.col("__r") <= k).drop("__r"))


def nearest_windows(index: PointIndex, windows: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """Windows (key, box) cut down around their middles to what can hold the k of their points nearest to it.

    As in ``knn_join``, but only nodes inside a window count: the radius surely holds k points of the window, or the
    window stays whole."""
    _positive(k)
    box = tuple(f"node_{b}" for b in BOX)
    of = [key, *WINDOW]
    by_far = Window.partitionBy(*of).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    proper = (F.col(WINDOW[0]) <= F.col(WINDOW[2])) & (F.col(WINDOW[1]) <= F.col(WINDOW[3]))
    named = windows.select(key, *[F.col(b).cast("double").alias(w) for b, w in zip(BOX, WINDOW)]).filter(proper).distinct()
    middle = {q: (F.col(WINDOW[i]) + F.col(WINDOW[i + 2])) / 2 for i, q in enumerate(("qx", "qy"))}
    frontier = named.withColumns(middle)
    for i in range(len(index.grid.shifts)):
        if i == 0:
            step = frontier.withColumn("node", F.explode(index.top_nodes())).select(*of, "qx", "qy", "node.*")
        else:
            step = frontier.drop("reach").withColumnsRenamed({"nx": "px", "ny": "py"}).join(index.level(i), ["px", "py"])
        whole = F.when(g.box_contains_box(WINDOW, box), F.col("node_n")).otherwise(0)
        frontier = (
            step.filter(g.boxes_intersect(WINDOW, box))
            .withColumn("near", g.box_min_distance(box, "qx", "qy"))
            .withColumn("far", g.box_max_distance(box, "qx", "qy"))
            .withColumn("held", F.sum(whole).over(by_far))
            .withColumn("reach", F.min(F.when(F.col("held") >= k, F.col("far"))).over(Window.partitionBy(*of)))
            .withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
            .filter((F.col("near") <= F.col("reach")) | F.isnan("near"))
            .select(*of, "qx", "qy", F.col("node_nx").alias("nx"), F.col("node_ny").alias("ny"), "reach")
        )
    reached = frontier.groupBy(*of, "qx", "qy").agg(F.max("reach").alias("reach"))
    r = F.col("reach") * (1 + 1e-9) + (F.abs("qx") + F.abs("qy")) * 1e-12  # rounding takes no point away
    open_ = F.isnan("reach") | F.isnan("qx") | F.isnan("qy")
    low = [F.when(open_, F.col(w)).otherwise(F.greatest(F.col(w), F.col(q) - r)) for w, q in zip(WINDOW, ("qx", "qy"))]
    high = [F.when(open_, F.col(w)).otherwise(F.least(F.col(w), F.col(q) + r)) for w, q in zip(WINDOW[2:], ("qx", "qy"))]
    return reached.select(key, *[v.alias(b) for v, b in zip(low + high, BOX)])


def knn_join(index: PointIndex, queries: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """The k nearest points of every query (key, qx, qy), all queries in one job.

    Walking down the pyramid, each query keeps the nodes that can still hold one of its k nearest: the running
    count over nodes by farthest corner gives a radius that surely holds k points, and nodes that start beyond
    it are dropped. The points of the surviving cells are then ranked. Nothing is approximate: box distances
    are never above, and corner distances never below, the distances of the points inside.
    """
    _positive(k)
    box = tuple(f"node_{b}" for b in BOX)
    by_far = Window.partitionBy(key).orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    frontier = queries.select(key, "qx", "qy")
    for i in range(len(index.grid.shifts)):
        if i == 0:
            step = frontier.withColumn("node", F.explode(index.top_nodes())).select(key, "qx", "qy", "node.*")
        else:
            step = frontier.drop("reach").withColumnsRenamed({"nx": "px", "ny": "py"}).join(index.level(i), ["px", "py"])
        frontier = (
            step.withColumn("near", g.box_min_distance(box, "qx", "qy"))
            .withColumn("far", g.box_max_distance(box, "qx", "qy"))
            .withColumn("held", F.sum("node_n").over(by_far))
            .withColumn("reach", F.min(F.when(F.col("held") >= k, F.col("far"))).over(whole))
            .withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))  # fewer than k points in all
            .filter(F.col("near") <= F.col("reach"))
            .select(key, "qx", "qy", F.col("node_nx").alias("nx"), F.col("node_ny").alias("ny"), "reach")
        )
    within = g.distance("x", "y", "qx", "qy") <= F.col("reach")
    candidates = index.join_points(index.stored(frontier), within, points=few_of_each_place(index, k))
    candidates = candidates.withColumn("dist", g.distance("x", "y", "qx", "qy")).drop("reach", "qx", "qy")
    return topk_refine(candidates, k, key)


def knn_sweep(index: PointIndex, queries: DataFrame, ks: list[int], key: str = "qid") -> DataFrame:
    """Several k at once: one join for the largest, smaller ones are rank filters. Adds column ``k``."""
    best = knn_join(index, queries, max(ks), key)
    sizes = F.array(*[F.lit(int(_positive(k))) for k in sorted(ks)])
    return best.withColumn("k", F.explode(F.filter(sizes, lambda k: k >= F.col("rank"))))
