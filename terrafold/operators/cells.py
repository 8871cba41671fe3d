"""Spatial partitioning as a column: every method adds ``cell_id`` (and never loses or repeats a row)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import codes
from terrafold.functions import geometry as g
from terrafold.functions.literals import double_array
from terrafold.functions.values import finite, known
from terrafold.plans.extent import Extent
from terrafold.plans.ordering import Cuts, add_buckets, exact_quantiles, fit_cuts, number_rows
from terrafold.plans.pyramid import box_aggregates
from terrafold.plans.session import bounded_broadcast, written

# Stripe count and default partition count of the fixed stripes.
STRIPES = 1000
GRID_PARTITIONS = 100

ROWS_PER_CELL = 1_000_000
MIN_CELLS = 16
SAMPLE_ROWS = 2_000_000


def default_cells(n: int, rows_per_cell: int = ROWS_PER_CELL) -> int:
    """How many cells suit n rows."""
    return max(MIN_CELLS, math.ceil(n / rows_per_cell))


def sample_rows(cells: int) -> int:
    """Size of the samples that cuts are taken from: 64 rows or more per wanted cell."""
    return max(SAMPLE_ROWS, 64 * cells)


def bounded_sample(points: DataFrame, n: int, cells: int, seed: int = 42) -> DataFrame:
    """All coordinates, or a seeded sample that still has 64 rows or more per wanted cell."""
    rows, source = sample_rows(cells), points.select("x", "y").filter(finite("x") & finite("y"))
    return source if n <= rows else source.sample(False, rows / n, seed)


# ---------------------------------------------------------------- stripes and grids


def fixed_stripes(points: DataFrame, ext: Extent | None = None, partitions: int = GRID_PARTITIONS) -> DataFrame:
    """Equal stripes along x: ``stripe`` 0..1000 and ``cell_id`` = stripe modulo partitions."""
    e = ext or Extent.of(points)
    out = points.withColumn("stripe", g.grid_index("x", e.min_x, e.width / STRIPES))
    return out.withColumn("cell_id", F.pmod("stripe", F.lit(partitions)).cast("int"))


def adaptive_stripes(points: DataFrame, ext: Extent | None = None, partitions: int = GRID_PARTITIONS) -> DataFrame:
    """Stripes along x whose count is the rows per partition."""
    e = ext or Extent.of(points)
    per_cell = e.n / min(partitions, e.n) if e.n else 1.0
    out = points.withColumn("stripe", g.grid_index("x", e.min_x, e.width / per_cell))
    return out.withColumn("cell_id", F.pmod("stripe", F.lit(partitions)).cast("int"))


def grid_cells(points: DataFrame, nx: int, ny: int | None = None, ext: Extent | None = None) -> DataFrame:
    """Two-dimensional equal grid, cell_id = cx + cy * nx; the high edges fold into the last cells."""
    e = ext or Extent.of(points)
    ny = ny or nx
    cx = g.grid_index("x", e.min_x, e.width / nx, nx)
    cy = g.grid_index("y", e.min_y, e.height / ny, ny)
    return points.withColumn("cell_id", (cx + cy * nx).cast("int"))


@dataclass(frozen=True)
class QuantileGrid:
    """x slices of equal sample count, and y cuts of equal sample count inside each slice.

    The y cuts of all slices are one ascending list, because slice + scaled y grows slice by slice: one
    binary search finds the cell.
    """

    x: Cuts
    xy: Cuts
    min_y: float
    span_y: float

    @classmethod
    def fit(cls, points: DataFrame, cells: int | None = None, ext: Extent | None = None) -> QuantileGrid:
        e = ext or Extent.of(points)
        want = cells or default_cells(e.n)
        slices = max(1, round(math.sqrt(want)))
        rows = max(1, math.ceil(want / slices))
        sample = bounded_sample(points, e.n, want)
        cx = fit_cuts(points, ["x"], slices, e.n)[0] if slices > 1 else Cuts(())
        span = (e.height or 1.0) * 1.0000001
        staged = cls(cx, Cuts(()), e.min_y, span)._position(sample)
        marks = double_array(i / rows for i in range(1, rows))
        found = (
            staged.groupBy("slice").agg(F.percentile_approx("__p", marks, F.lit(10_000)).alias("q")).collect()
            if rows > 1 else []
        )  # one array per slice: fewer values than cells
        borders = [float(i) for i in range(1, cx.buckets)]
        inner = [v for r in found if r["q"] for v in r["q"]]  # missing coordinates have no quantiles
        return cls(cx, Cuts(tuple(sorted(set(borders + inner)))), e.min_y, span)

    def _position(self, points: DataFrame) -> DataFrame:
        # y is clamped so that points outside the fitted extent stay in their slice
        share = F.least(F.greatest((known("y") - F.lit(self.min_y)) / F.lit(self.span_y), F.lit(0.0)), F.lit(0.9999999))
        return add_buckets(points, slice=("x", self.x)).withColumn("__p", F.col("slice") + share)

    def assign(self, points: DataFrame) -> DataFrame:
        return add_buckets(self._position(points), cell_id=("__p", self.xy)).drop("slice", "__p")


def quantile_grid(points: DataFrame, cells: int | None = None, ext: Extent | None = None) -> DataFrame:
    return QuantileGrid.fit(points, cells, ext).assign(points)


# ---------------------------------------------------------------- quad tree


def quad_codes(points: DataFrame, depth: int, ext: Extent | None = None) -> DataFrame:
    """Quad code of every point at one uniform depth."""
    e = ext or Extent.of(points)
    placed = codes.add_quad_number(points, e, depth)
    return placed.withColumn("code", codes.quad_text(F.col("quad"), depth)).drop("quad")


def quad_rollup(points: DataFrame, depth: int, ext: Extent | None = None) -> DataFrame:
    """Counts per zone on every level 1..depth: (level, code, n). The points are aggregated once."""
    e = ext or Extent.of(points)
    finest = codes.add_quad_number(points, e, depth).groupBy("quad").agg(F.count(F.lit(1)).alias("c"))
    text = codes.quad_text(F.col("quad"), depth)
    level = F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")
    return (
        finest.select("c", text.alias("full"), level)
        .groupBy("level", F.substring("full", F.lit(1), F.col("level")).alias("code"))
        .agg(F.sum("c").alias("n"))
    )


@dataclass(frozen=True)
class QuadTree:
    """Leaves of an adaptive quad tree, in Z-order; leaf i holds quad numbers [start_i, start_(i+1))."""

    ext: Extent
    depth: int
    leaves: tuple[tuple[int, int, int], ...]  # start, level, n

    @classmethod
    def fit(
        cls, points: DataFrame, cells: int | None = None, depth: int | None = None, ext: Extent | None = None,
        cap: int | None = None,
    ) -> QuadTree:
        """Split every zone that holds more than ``cap`` points, down to ``depth``.

        One aggregate over the points at the finest depth; everything above is a roll-up of those counts. A
        level has at most n / cap zones over the cap, so at most 3 * depth * cells + 1 leaves come back.
        """
        e = ext or Extent.of(points)
        want = cells or default_cells(e.n)
        depth = codes.check_depth(depth or min(16, math.ceil(math.log(max(want, 4), 4)) + 5))
        limit = cap or max(1, e.n // want)
        finest = (
            codes.add_quad_number(points, e, depth).groupBy("quad").agg(F.count(F.lit(1)).alias("c"))
        )
        level = F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")
        nodes = (
            finest.select("quad", "c", level)
            .groupBy("level", F.expr(f"shiftright(quad, cast(2 * ({depth} - level) as int))").alias("node"))
            .agg(F.sum("c").alias("n"))
        )
        # a zone over the cap is split: fetch it together with the counts of its (at most four) quarters
        split = (
            nodes.groupBy((F.col("level") - 1).alias("level"), F.shiftright("node", 2).alias("node"))
            .agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("node").alias("child"), "n")).alias("quarters"))
            .filter(F.col("n") > limit)
        )
        splits = {(r["level"], r["node"]): {q["child"]: q["n"] for q in r["quarters"]} for r in split.collect()}
        if not splits:
            return cls(e, depth, ((0, 0, e.n),))
        leaves = []
        for (up, parent), quarters in splits.items():
            for child in range(parent * 4, parent * 4 + 4):
                if (up + 1, child) not in splits:
                    leaves.append((child * 4 ** (depth - up - 1), up + 1, quarters.get(child, 0)))
        return cls(e, depth, tuple(sorted(leaves)))

    @property
    def cuts(self) -> Cuts:
        return Cuts(tuple(float(start) for start, _, _ in self.leaves[1:]))

    def assign(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """Leaf number of every point; null outside the fitted extent."""
        placed = codes.add_quad_number(points, self.ext, self.depth, "__quad", x, y)
        return add_buckets(placed, cell_id=("__quad", self.cuts)).drop("__quad")

    def zones(self, spark: SparkSession) -> DataFrame:
        """(zone_id, code, level, n, box) of all leaves; boxes are half-open tiles of the padded extent."""
        rows = []
        for i, (start, level, n) in enumerate(self.leaves):
            digits = [(start >> 2 * (self.depth - lv)) & 3 for lv in range(1, level + 1)]
            col = sum((d & 1) << (level - 1 - i) for i, d in enumerate(digits))
            row = sum((1 - (d >> 1)) << (level - 1 - i) for i, d in enumerate(digits))
            w, h = (self.ext.width + codes.EDGE_PAD) / 2**level, (self.ext.height + codes.EDGE_PAD) / 2**level
            x0, y0 = self.ext.min_x + col * w, self.ext.min_y + row * h
            rows.append((i, "".join(map(str, digits)), level, n, x0, y0, x0 + w, y0 + h))
        schema = "zone_id int, code string, level int, n bigint, min_x double, min_y double, max_x double, max_y double"
        return spark.createDataFrame(rows, schema)

    def zones_for_window(self, spark: SparkSession, window: tuple[float, float, float, float]) -> DataFrame:
        return self.zones(spark).filter(g.boxes_intersect(window, ("min_x", "min_y", "max_x", "max_y")))


def quad_tree_cells(
    points: DataFrame, cells: int | None = None, depth: int | None = None, ext: Extent | None = None
) -> DataFrame:
    return QuadTree.fit(points, cells, depth, ext).assign(points)


# ---------------------------------------------------------------- KD tree


@dataclass(frozen=True)
class KdTree:
    """Median splits, x first, then y in turns; splits[l][i] belongs to node i of level l."""

    splits: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(
        cls, points: DataFrame, cells: int | None = None, ext: Extent | None = None, exact: bool = False, seed: int = 42
    ) -> KdTree:
        """Medians of a bounded sample by default; ``exact`` takes them from all rows, one pass per level."""
        e = ext or Extent.of(points)
        want = max(1, cells or default_cells(e.n))
        depth = math.ceil(math.log2(want))
        source = points.select("x", "y").filter(finite("x") & finite("y")) if exact else written(bounded_sample(points, e.n, want, seed), "kd-sample")
        splits: list[tuple[float, ...]] = []
        for level in range(depth):
            axis = "xy"[level % 2]
            placed = cls(tuple(splits)).assign(source, "node")
            if exact:
                medians = exact_quantiles(placed, axis, [0.5], by=["node"], n=e.n)
            else:
                medians = placed.groupBy("node").agg(F.percentile_approx(axis, 0.5, 10_000).alias("value"))
            found = {r["node"]: r["value"] for r in medians.select("node", "value").collect()}  # 2 ** level rows
            splits.append(tuple(float(found.get(i, math.inf)) for i in range(2**level)))
        return cls(tuple(splits))

    def assign(self, points: DataFrame, name: str = "cell_id") -> DataFrame:
        """Walk down one level per column; every level is a lookup in a literal array. Missing coordinates have no cell."""
        out = points.withColumn(name, F.when(finite("x") & finite("y"), F.lit(0)))
        for level, values in enumerate(self.splits):
            split = F.element_at(double_array(values), F.col(name) + 1)
            right = (F.col("xy"[level % 2]) >= split).cast("int")
            out = out.withColumn(name, F.col(name) * 2 + right)
        return out

    def zones(self, spark: SparkSession, ext: Extent) -> DataFrame:
        """Half-open leaf boxes of the padded extent."""
        boxes = [(ext.min_x, ext.min_y, ext.max_x + codes.EDGE_PAD, ext.max_y + codes.EDGE_PAD)]
        for level, values in enumerate(self.splits):
            nxt = []
            for (x0, y0, x1, y1), s in zip(boxes, values):
                if level % 2 == 0:
                    s = min(s, x1)
                    nxt += [(x0, y0, s, y1), (s, y0, x1, y1)]
                else:
                    s = min(s, y1)
                    nxt += [(x0, y0, x1, s), (x0, s, x1, y1)]
            boxes = nxt
        rows = [(i, *b) for i, b in enumerate(boxes)]
        return spark.createDataFrame(rows, "zone_id int, min_x double, min_y double, max_x double, max_y double")


def kd_tree_cells(points: DataFrame, cells: int | None = None, ext: Extent | None = None, exact: bool = False) -> DataFrame:
    return KdTree.fit(points, cells, ext, exact).assign(points)


# ---------------------------------------------------------------- sort-tile boxes


def _tile_of(position: Column, size: Column, tiles: int) -> Column:
    """ntile: which of ``tiles`` nearly equal runs a 0-based position falls into (0-based)."""
    q, r = F.floor(size / tiles), size % tiles
    long_part = r * (q + 1)
    return F.when(position < long_part, F.floor(position / (q + 1))).otherwise(
        r + F.floor((position - long_part) / F.greatest(q, F.lit(1)))
    )


def sort_tiles(points: DataFrame, slices: int, rows: int, n: int | None = None) -> DataFrame:
    """Sort-tile packing on all rows: slices of equal count by x, tiles of equal count by y in each slice.

    Two range partitionings, one by x and one by slice and y, and offsets per range: the same at any size.
    """
    total = points.count() if n is None else n
    by_x = number_rows(points, ["x", "y", "id"], "__px", n=total)
    sliced = by_x.withColumn("slice", _tile_of(F.col("__px"), F.lit(total).cast("bigint"), slices).cast("int"))
    by_y = number_rows(sliced.drop("__px"), ["y", "x", "id"], "__py", by=["slice"], n=total)
    size = (F.lit(total // slices) + (F.col("slice") < total % slices).cast("bigint")).cast("bigint")
    tile = _tile_of(F.col("__py"), size, rows).cast("int")
    return by_y.withColumn("cell_id", F.col("slice") * rows + tile).drop("__py", "slice")


def tile_boxes(tiled: DataFrame) -> DataFrame:
    """Bounding box per tile: (box_id, n, box)."""
    return tiled.groupBy(F.col("cell_id").alias("box_id")).agg(*box_aggregates())


def sort_tile_boxes(points: DataFrame, cells: int | None = None, ext: Extent | None = None) -> DataFrame:
    """Boxes of a sort-tile packing of all points with coordinates, exact at any size."""
    e = ext or Extent.of(points)
    want = cells or default_cells(e.n)
    slices = max(1, math.ceil(math.sqrt(want)))
    known = points.filter(finite("x") & finite("y"))
    rows = known.select("x", "y", F.xxhash64("x", "y").alias("id"))
    tiled = sort_tiles(written(rows, "tile-rows"), slices, math.ceil(want / slices))
    return written(tile_boxes(tiled), "boxes")  # at most ``cells`` rows


def assign_to_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """First (smallest id) closed box that contains each point, or -1.

    Boxes are listed per cell of a grid cut at the quantiles of the box corners, about one box per cell
    however the boxes crowd, so a point only looks at the few boxes of its own cell.
    """
    n = boxes.count()
    side = max(1, math.ceil(math.sqrt(n)))
    cx, cy = fit_cuts(boxes, ["min_x", "min_y"], side, n) if side > 1 else (Cuts(()), Cuts(()))
    spans = add_buckets(boxes, x0=("min_x", cx), x1=("max_x", cx), y0=("min_y", cy), y1=("max_y", cy))
    listed = (
        spans.withColumn("gx", F.explode(F.sequence("x0", "x1")))
        .withColumn("gy", F.explode(F.sequence("y0", "y1")))
        .groupBy("gx", "gy")
        .agg(F.sort_array(F.collect_list(F.struct("box_id", "min_x", "min_y", "max_x", "max_y"))).alias("boxes"))
    )
    hits = F.filter(
        "boxes",
        lambda b: F.col("x").between(b["min_x"], b["max_x"]) & F.col("y").between(b["min_y"], b["max_y"]),
    )
    return (
        add_buckets(points, gx=("x", cx), gy=("y", cy))
        .join(bounded_broadcast(listed, cx.buckets * cy.buckets), ["gx", "gy"], "left")
        .withColumn("cell_id", F.coalesce(F.get(hits, F.lit(0))["box_id"], F.lit(-1)).cast("int"))
        .drop("gx", "gy", "boxes")
    )
