"""Polygons or windows as quad nodes: the static side of a join with points that are not indexed, a stream above all.

Every shape is cut into nodes of a quad tree over the extent of all shapes. A node that lies inside its shape is
settled; a node on the border keeps the edges near it (and the parity of those beyond) and is cut again until it is
small against its shape and few edges are left. A point has one node per level in use, so the join is an equi-join on (level, node) and needs no
statistics of the points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.values import finite
from terrafold.plans.pyramid import BORDER, BOX, COVERED, DISJOINT, JOIN_SALTS
from terrafold.plans.session import BROADCAST_ROWS, written

STEP = 2  # halvings of both axes between two levels: 16 children per node
DEPTH = 7
EDGES_PER_NODE = 16
BROADCAST_EDGES = 1_000_000
PAD = 1e-9  # of the extent: a point that rounding puts into the next node still meets every edge near it
SHAPE = tuple(f"s_{b}" for b in BOX)


@dataclass(frozen=True)
class ShapeCover:
    """Written nodes (level, node, key, covered, edges, box of the shape) and the extent that they divide."""

    nodes: DataFrame
    key: str
    extent: tuple[float, float, float, float]
    depth: int
    levels: tuple[int, ...]  # that hold nodes
    light: bool  # few enough rows and edges to be broadcast
    boxes: bool

    @classmethod
    def of_polygons(
        cls, polygons: DataFrame, key: str = "poly_id", depth: int = DEPTH, edges_per_node: int = EDGES_PER_NODE
    ) -> ShapeCover:
        """Polygons (key, ring); containment is even-odd with the half-open edge rule. One without vertices covers nothing."""
        edges = g.ring_edges(g.close_ring("ring"))
        sides = polygons.select(key, edges.alias("edges"), *[b.alias(s) for b, s in zip(g.ring_box("ring"), SHAPE)])
        return cls._build(sides, key, depth, edges_per_node, boxes=False)

    @classmethod
    def of_windows(cls, windows: DataFrame, key: str = "qid", depth: int = DEPTH) -> ShapeCover:
        """Closed windows (key, min_x, min_y, max_x, max_y); an inverted one covers nothing."""
        none = F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")
        sides = windows.select(key, none.alias("edges"), *[F.col(b).cast("double").alias(s) for b, s in zip(BOX, SHAPE)])
        proper = (F.col(SHAPE[0]) <= F.col(SHAPE[2])) & (F.col(SHAPE[1]) <= F.col(SHAPE[3]))
        return cls._build(sides.filter(proper).distinct(), key, depth, EDGES_PER_NODE, boxes=True)

    @classmethod
    def _build(cls, sides: DataFrame, key: str, depth: int, edges_per_node: int, boxes: bool) -> ShapeCover:
        spark = sides.sparkSession
        shapes = written(sides.filter(finite(SHAPE[0]) & finite(SHAPE[1]) & finite(SHAPE[2]) & finite(SHAPE[3])), "shapes")
        ends = [F.min(SHAPE[0]), F.min(SHAPE[1]), F.max(SHAPE[2]), F.max(SHAPE[3])]
        found = shapes.agg(*[e.alias(b) for e, b in zip(ends, BOX)]).first()
        extent = tuple(0.0 if found[b] is None else float(found[b]) for b in BOX)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

        kept = [key, "edges", *SHAPE]
        open_ = shapes.select(*kept, F.lit(0).alias("col"), F.lit(0).alias("row"))
        done: list[DataFrame] = []
        for level in range(depth + 1):
            side = 2 ** (STEP * level)
            box = _node_box(extent, side)
            state = _box_state(box) if boxes else _ring_state(box)
            border = F.col("state") == BORDER
            near = _edges_near(box)
            width, height = (extent[2] - extent[0]) / side, (extent[3] - extent[1]) / side
            small = (F.lit(2 * width) <= F.col(SHAPE[2]) - F.col(SHAPE[0])) | (F.lit(2 * height) <= F.col(SHAPE[3]) - F.col(SHAPE[1]))
            last = F.lit(level == depth) | (small & (F.size("near") <= edges_per_node))
            # a round ends in shared storage, dealt evenly: a shape of many nodes is not one task's work
            met = open_.withColumn("state", state).filter(F.col("state") != DISJOINT).withColumn(
                "near", F.when(border, near).otherwise(F.slice("edges", 1, 0))
            ).select(
                key, F.col("near").alias("edges"), *SHAPE, "col", "row", (~border).alias("covered"),
                (~border | last).alias("settled"),
            )
            met = written(met.repartition(tasks), "cover-level")
            node = (F.col("col").cast("bigint") * 2**32 + F.col("row")).alias("node")
            done.append(met.filter("settled").select(F.lit(level).alias("level"), node, key, "covered", "edges", *SHAPE))
            rest = met.filter("NOT settled")
            if level == depth or not rest.limit(1).count():
                break
            steps = F.array(*[F.lit(i) for i in range(2**STEP)])
            open_ = (
                rest.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
                .select(*kept, (F.col("col") * 2**STEP + F.col("dx")).alias("col"), (F.col("row") * 2**STEP + F.col("dy")).alias("row"))
            )
        nodes = done[0]
        for more in done[1:]:
            nodes = nodes.unionByName(more)
        nodes = written(nodes, "cover")
        sizes = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("edges")).alias("edges")).collect()
        light = sum(r["n"] for r in sizes) <= BROADCAST_ROWS and sum(r["edges"] for r in sizes) <= BROADCAST_EDGES
        return cls(nodes, key, extent, len(done) - 1, tuple(sorted(r["level"] for r in sizes)), light, boxes)

    def join(self, points: DataFrame) -> DataFrame:
        """All (key, point) pairs with the point in the shape, for a table or a stream of points: nothing is kept
        between batches. A point column that is named like the key is replaced by it."""
        side = 2 ** (STEP * self.depth)
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        column, row = _cell(x, self.extent[0], self.extent[2], side), _cell(y, self.extent[1], self.extent[3], side)
        places = F.array(*[
            F.struct(
                F.lit(level).alias("level"),
                (F.shiftright(column, STEP * (self.depth - level)).cast("bigint") * 2**32 + F.shiftright(row, STEP * (self.depth - level))).alias("node"),
            )
            for level in self.levels
        ]) if self.levels else F.array().cast("array<struct<level: int, node: bigint>>")
        inside = g.box_contains_point(*self.extent, x, y) & finite("x") & finite("y")
        own = [c for c in points.columns if c != self.key]
        placed = points.select(*own).filter(inside).withColumn("__at", F.explode(places)).withColumns(
            {"__level": F.col("__at.level"), "__cell": F.col("__at.node")}
        ).drop("__at")
        names = {"level": "__level", "node": "__cell", "edges": "__edges", "covered": "__covered", **{s: f"__{s}" for s in SHAPE}}
        nodes, on = self.nodes.withColumnsRenamed(names), ["__level", "__cell"]
        if self.light:
            nodes = F.broadcast(nodes)
        else:
            # points of one place are dealt to several tasks, each with the place's nodes
            placed = placed.withColumn("__deal", F.pmod(F.xxhash64(*own), F.lit(JOIN_SALTS)).cast("int"))
            nodes, on = nodes.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))), [*on, "__deal"]
        here = g.box_contains_point(*[f"__{s}" for s in SHAPE], "x", "y")
        if not self.boxes:
            here = here & g.edges_contain("__edges", "x", "y")
        return placed.join(nodes, on).filter(F.col("__covered") | here).select(self.key, *own)


def _node_box(extent: tuple[float, float, float, float], side: int) -> tuple[Column, Column, Column, Column]:
    """Box of node (col, row) among ``side`` per axis, a little larger than what its points can reach."""
    width, height = extent[2] - extent[0], extent[3] - extent[1]
    far = max(abs(v) for v in extent)
    px, py = max(width * PAD, far * 1e-14), max(height * PAD, far * 1e-14)
    x0, y0 = F.lit(extent[0]) + F.col("col") * F.lit(width / side), F.lit(extent[1]) + F.col("row") * F.lit(height / side)
    return x0 - F.lit(px), y0 - F.lit(py), x0 + F.lit(width / side + px), y0 + F.lit(height / side + py)


def _cell(value: Column, low: float, high: float, side: int) -> Column:
    if high <= low:
        return F.lit(0)
    at = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(side)).cast("int")
    return F.least(F.greatest(at, F.lit(0)), F.lit(side - 1))


def _box_state(box: tuple[Column, ...]) -> Column:
    return F.when(~g.boxes_intersect(SHAPE, box), DISJOINT).when(g.box_contains_box(SHAPE, box), COVERED).otherwise(BORDER)


def _ring_state(box: tuple[Column, ...]) -> Column:
    # no edge near the node's box: all of it is on one side, and one corner tells which
    return (
        F.when(~g.boxes_intersect(SHAPE, box), DISJOINT)
        .when(g.edges_touch_box("edges", box), BORDER)
        .when(g.edges_contain("edges", box[0], box[1]), COVERED)
        .otherwise(DISJOINT)
    )


def _edges_near(box: tuple[Column, ...]) -> Column:
    """Edges that a ray going right from a point of the box can meet. Those to the right of the box that go through its
    whole height meet every ray: of them only the parity matters, so one stays or none."""

    def right(e: Column) -> Column:
        return F.least(e["x1"], e["x2"]) > box[2]

    def through(e: Column) -> Column:
        return (F.least(e["y1"], e["y2"]) <= box[1]) & (F.greatest(e["y1"], e["y2"]) > box[3])

    met = F.filter(
        "edges",
        lambda e: (F.least(e["y1"], e["y2"]) <= box[3])
        & (F.greatest(e["y1"], e["y2"]) >= box[1])
        & (F.greatest(e["x1"], e["x2"]) >= box[0])
        & ~(right(e) & through(e)),
    )
    beyond = F.filter("edges", lambda e: right(e) & through(e))
    return F.concat(met, F.slice(beyond, 1, F.size(beyond) % 2))
