"""A point table with a rank grid and a cell pyramid: the plan behind every batch join.

* The rank grid cuts each axis at sample quantiles, so cells are small where points are dense. A coordinate
  value that holds more than one share of its axis is fenced into a bucket of its own, so a cell stays within
  one share of the rows unless its points are one single location.
* A table too large for one grid gets a nested one: cells with too many points are cut again, each at quantiles
  of its own points, until none is left, so a cell keeps its size however large the table is.
* The pyramid keeps count and tight bounding box per cell and for coarser levels above.
* Points are stored once, in folders by a coarse node and sorted by cell inside them. A batch reads only the
  folders, and by Parquet statistics the row groups, of cells that occur in its (query, cell) pairs.
* Batches of windows, polygons or query points walk the pyramid from the top with one equi-join per level.
  Only pairs that can still matter survive a level, so no cross join and no range join is planned, and a node
  that lies wholly inside a window is settled by its count without reading its points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.literals import double_text, is_one_of
from terrafold.functions.values import known
from terrafold.plans.extent import Extent
from terrafold.plans.ordering import SAMPLE_SEED, SAMPLES_PER_PART, Cuts, add_buckets, fit_quantiles
from terrafold.plans.session import BROADCAST_ROWS, bounded_broadcast, written

POINTS_PER_CELL = 64
MIN_CELL_BITS = 4
MAX_CELL_BITS = 24  # of one grid; larger tables get a nested one
MAX_AXIS_BITS = 14
INNER_BITS = 16  # that one round of nesting adds to a cell at most
INNER_AXIS_BITS = 12
NUMBER_BITS = 30  # of a bucket number per axis
BROADCAST_CUTS = 2_000_000
JOIN_SALTS = 32
STEP_BITS = 4  # bits of both axes together between two levels: about 16 children per node
HOT_ROWS = 1_000_000  # a cell above this many rows is split, however many rows there are in all
ROWS_PER_FOLDER = 1_000_000
FOLDER_BITS = 16
ROWS_PER_FILE = 5_000_000
MIN_ROWS_PER_FILE = 10_000
NO_NODE_KEYS = 1_024  # that pairs which are settled already are spread over
FEW_QUERIES = 64  # of a batch that leaves the points where they are
PACKED_ROWS = 16_384  # points of a part that is one row of a large batch's join
LEAST_SHARE, MOST_SHARE = 2**22, 2**30  # pairs of a query and a point that one task of a large batch may meet
MAX_DEALS = 8_192  # tasks of a large batch
NODE, SALT, SINGLE = "__node", "__salt", "__single"
PLACED = ("bx", "by", NODE, SALT, SINGLE)  # what the stored points carry beside their own columns
BOX = ("min_x", "min_y", "max_x", "max_y")

# States of a (query, node) pair.
DISJOINT, BORDER, COVERED = 0, 1, 2


def box_aggregates(x: str = "x", y: str = "y") -> list[Column]:
    """Count and bounding box of points; missing coordinates do not stretch the box."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.min(known(x)).alias("min_x"),
        F.min(known(y)).alias("min_y"),
        F.max(known(x)).alias("max_x"),
        F.max(known(y)).alias("max_y"),
    ]


def merged_box_aggregates() -> list[Column]:
    """Count and bounding box from partial counts and boxes."""
    return [
        F.sum("n").alias("n"),
        F.min("min_x").alias("min_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"),
        F.max("max_y").alias("max_y"),
    ]


@dataclass(frozen=True)
class RankGrid:
    """Quantile cuts per axis and the bit shifts (x, y) of the levels above, coarsest first, ending in (0, 0)."""

    x: Cuts
    y: Cuts
    shifts: tuple[tuple[int, int], ...]

    @classmethod
    def fit(
        cls, points: DataFrame, n: int, x: str = "x", y: str = "y", per_cell: int = POINTS_PER_CELL,
        cell_bits: int = MAX_CELL_BITS,
    ) -> RankGrid:
        total = min(cell_bits, max(MIN_CELL_BITS, math.ceil(math.log2(max(1.0, n / per_cell)))))
        finest = min(MAX_AXIS_BITS, total - total // 4)
        qx, qy = fit_quantiles(points, [x, y], 2**finest, n)
        sx, sy = _spread(qx), _spread(qy)
        # split the bits so that typical cells are near square in data units, each axis keeping a quarter
        tilt = round(math.log2(sx / sy)) if sx > 0 and sy > 0 else 0
        bits_x = min(finest, max(total - finest, total // 4, (total + tilt) // 2))
        bits_y = total - bits_x
        cx, cy = _thin(qx, finest - bits_x), _thin(qy, finest - bits_y)
        used_x, used_y = _bits(cx), _bits(cy)
        return cls(cx, cy, _levels(used_x, used_y, sx, sy))

    @property
    def base(self) -> RankGrid:
        return self

    @property
    def width(self) -> tuple[int, int]:
        """Bits of the bucket numbers."""
        return _bits(self.x), _bits(self.y)

    def add(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        return add_buckets(df, bx=(x, self.x), by=(y, self.y))


@dataclass(frozen=True)
class NestedGrid:
    """A grid whose crowded cells are cut again at quantiles of their own points.

    A bucket number is the outer number followed by ``bits`` of the inner one, so the levels of both stand in one
    list of shifts and nothing that walks the pyramid needs to know of the nesting.
    """

    outer: RankGrid | NestedGrid
    cuts: DataFrame  # bx, by, xs, ys: a row per crowded cell
    light: bool  # few enough rows and values to be broadcast
    bits: tuple[int, int]

    @classmethod
    def fit(cls, points: DataFrame, outer: RankGrid | NestedGrid, per_cell: int = POINTS_PER_CELL) -> NestedGrid | None:
        """One more round, or None when no cell needs one (or the bucket numbers are used up).

        The sample behind the cuts of a cell has about SAMPLES_PER_PART * 2 ** INNER_AXIS_BITS rows at most,
        whatever share of the points the cell holds.
        """
        room = [min(INNER_AXIS_BITS, NUMBER_BITS - used) for used in outer.width]
        placed = outer.add(points.select("x", "y")).filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
        wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
        wanted = F.least(F.lit(INNER_BITS), F.ceil(F.log2(F.col("n") / per_cell)).cast("int"))
        tilted = F.floor((wanted + F.round(F.log2(wide / high))) / 2)
        quarter = F.floor(wanted / 4)
        bits_x = F.when(high == 0, wanted).when(wide == 0, 0).otherwise(F.least(F.greatest(tilted, quarter), wanted - quarter))
        crowded = written(
            placed.groupBy("bx", "by").agg(*box_aggregates())
            .filter((F.col("n") > per_cell * 2**MIN_CELL_BITS) & ((wide > 0) | (high > 0)))
            .select("bx", "by", "n", wanted.alias("wanted"), bits_x.cast("int").alias("bits_x"))
            .select(
                "bx", "by", "n", F.least("bits_x", F.lit(room[0])).alias("bits_x"),
                F.least(F.col("wanted") - F.col("bits_x"), F.lit(room[1])).alias("bits_y"),
            ),
            "crowded-cells",
        )
        cells = crowded.count()
        if not cells:
            return None
        finest = F.greatest("bits_x", "bits_y")
        drawn = beside(placed, crowded, cells <= BROADCAST_ROWS).filter(
            F.rand(SAMPLE_SEED) < F.lit(SAMPLES_PER_PART) * F.pow(F.lit(2.0), finest) / F.col("n")
        )
        sampled = drawn.groupBy("bx", "by", "bits_x", "bits_y").agg(
            F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("xs"),
            F.sort_array(F.collect_list(F.col("y").cast("double"))).alias("ys"),
        )
        cuts = written(sampled.select("bx", "by", _own_cuts("xs", "bits_x").alias("xs"), _own_cuts("ys", "bits_y").alias("ys")), "inner-cuts")
        size = cuts.agg(
            F.max(F.size("xs")).alias("x"), F.max(F.size("ys")).alias("y"), F.sum(F.size("xs") + F.size("ys")).alias("values")
        ).first()
        if not size["values"]:
            return None
        bits = (size["x"] or 0).bit_length(), (size["y"] or 0).bit_length()
        return cls(outer, cuts, cells <= BROADCAST_ROWS and size["values"] <= BROADCAST_CUTS, bits)

    @property
    def base(self) -> RankGrid:
        return self.outer.base

    @property
    def width(self) -> tuple[int, int]:
        return self.outer.width[0] + self.bits[0], self.outer.width[1] + self.bits[1]

    @property
    def shifts(self) -> tuple[tuple[int, int], ...]:
        ix, iy = self.bits
        return (*[(sx + ix, sy + iy) for sx, sy in self.outer.shifts], *_levels(ix, iy, 1.0, 1.0))

    def add(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        cuts = self.cuts.withColumnsRenamed({"xs": "__xs", "ys": "__ys"})
        placed = beside(self.outer.add(df, x, y), cuts, self.light, "left")
        numbers = {
            name: F.shiftleft(F.col(name), bits) + count_at_most(values, known(axis), bits)
            for name, values, axis, bits in (("bx", "__xs", x, self.bits[0]), ("by", "__ys", y, self.bits[1]))
        }
        return placed.withColumns(numbers).select(*df.columns, "bx", "by")


def fit_grid(points: DataFrame, n: int, per_cell: int = POINTS_PER_CELL, cell_bits: int = MAX_CELL_BITS) -> RankGrid | NestedGrid:
    """One grid while its cells can keep their size, else rounds of nested ones until no cell is crowded."""
    if n <= per_cell * 2**cell_bits:
        return RankGrid.fit(points, n, per_cell=per_cell, cell_bits=cell_bits)
    grid = RankGrid.fit(points, n, per_cell=per_cell, cell_bits=min(cell_bits, FOLDER_BITS))
    while inner := NestedGrid.fit(points, grid, per_cell):
        grid = inner
    return grid


def beside(placed: DataFrame, cells: DataFrame, light: bool, how: str = "inner", on: tuple[str, ...] = ("bx", "by")) -> DataFrame:
    """Points with the row of their cell: by broadcast, or dealt by cell and salt, so that no cell is one task."""
    if light:
        return placed.join(F.broadcast(cells), list(on), how)
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(JOIN_SALTS)).cast("int")
    copies = cells.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return placed.withColumn("__deal", salt).join(copies, [*on, "__deal"], how).drop("__deal")


def _own_cuts(values: str, bits: str) -> Column:
    """Distinct quantiles that cut sorted values into 2 ** bits parts; one drawn twice is fenced by the next double."""
    parts = F.expr(f"shiftleft(1, {bits})")
    ranks = F.when(F.col(bits) > 0, F.sequence(F.lit(1), parts - 1)).otherwise(F.array().cast("array<int>"))
    drawn = F.transform(ranks, lambda i: F.get(values, F.greatest(F.ceil(i * F.size(values) / parts).cast("int") - 1, F.lit(0))))
    again = F.filter(drawn, lambda v, i: (i > 0) & (v == F.get(drawn, i - 1)))
    return F.array_sort(F.array_distinct(F.concat(drawn, F.transform(again, next_double))))


def next_double(v: Column) -> Column:
    """The smallest double above a finite one: a little over half a unit in the last place, rounded."""
    return v + F.greatest(F.abs(v) * F.lit(2.0**-53 * (1 + 2.0**-52)), F.lit(5e-324))


def count_at_most(cuts: str, value: Column, bits: int) -> Column:
    """How many cuts are at most the value, by binary search; 0 where there are none."""
    if not bits:
        return F.lit(0)
    steps = F.array(*[F.lit(2**i) for i in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def _spread(quantiles: list[float]) -> float:
    """Range of the middle 90 %, which outliers do not stretch."""
    if not quantiles:
        return 0.0
    last = len(quantiles) - 1
    return quantiles[math.ceil(last * 0.95)] - quantiles[math.floor(last * 0.05)]


def _thin(quantiles: list[float], halvings: int) -> Cuts:
    step = 2**halvings
    return Cuts.from_quantiles(quantiles[step - 1 :: step])


def _bits(cuts: Cuts) -> int:
    return math.ceil(math.log2(max(cuts.buckets, 2)))


def _levels(bits_x: int, bits_y: int, size_x: float, size_y: float) -> tuple[tuple[int, int], ...]:
    """From the top, give STEP_BITS per level to whichever axis has the longer node side left."""
    shifts, sx, sy = [], bits_x, bits_y
    side_x, side_y = size_x or 1.0, size_y or 1.0
    while sx or sy:
        for _ in range(STEP_BITS):
            if sx and (side_x >= side_y or not sy):
                sx, side_x = sx - 1, side_x / 2
            elif sy:
                sy, side_y = sy - 1, side_y / 2
        shifts.append((sx, sy))
    return tuple(shifts)


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@dataclass
class PointIndex:
    """Stored points (id, x, y, ...) with their rank cell (bx, by), and the written pyramid.

    ``__node`` is the folder, ``__salt`` the part of a split cell and ``__single`` marks the points of a split
    cell that is one location. A point without coordinates has no cell and lies in a folder of its own.
    """

    points: DataFrame
    grid: RankGrid | NestedGrid
    pyramid: DataFrame  # level, nx, ny, n, box
    extent: Extent
    top: list[tuple]  # nodes of the coarsest level, at most 2 ** STEP_BITS
    folder_level: int
    hot: DataFrame | None = None  # hx, hy, splits, single: cells above the row limit

    @classmethod
    def build(
        cls, points: DataFrame, per_cell: int = POINTS_PER_CELL, hot_rows: int = HOT_ROWS,
        rows_per_folder: int = ROWS_PER_FOLDER, cell_bits: int = MAX_CELL_BITS,
    ) -> PointIndex:
        ext = Extent.of(points)
        grid = fit_grid(points, ext.n, per_cell, cell_bits)
        placed = grid.add(points)
        cells = placed.filter(F.col("bx").isNotNull() & F.col("by").isNotNull()).groupBy("bx", "by").agg(*box_aggregates())
        places = F.array(*[
            F.struct(F.lit(i).alias("level"), F.shiftright("bx", sx).alias("nx"), F.shiftright("by", sy).alias("ny"))
            for i, (sx, sy) in enumerate(grid.shifts)
        ])
        levels = cells.withColumn("p", F.explode(places)).groupBy("p.level", "p.nx", "p.ny")
        pyramid = written(levels.agg(*merged_box_aggregates()), "pyramid", partition_by="level")
        top = [(r["nx"], r["ny"], r["n"], *[r[b] for b in BOX]) for r in pyramid.filter("level = 0").collect()]

        finest = len(grid.shifts) - 1
        single = (F.col("min_x") == F.col("max_x")) & (F.col("min_y") == F.col("max_y"))
        crowded = pyramid.filter((F.col("level") == finest) & (F.col("n") > hot_rows)).select(
            F.col("nx").alias("hx"), F.col("ny").alias("hy"),
            F.ceil(F.col("n") / hot_rows).cast("int").alias("splits"), single.alias("single"),
        )
        hot = written(crowded, "hot-cells") if crowded.limit(1).count() else None
        level = _folder_level(grid.shifts, ext.n, rows_per_folder)
        return cls(_store(placed, grid, ext.n, level, hot), grid, pyramid, ext, sorted(top), level, hot)

    # ------------------------------------------------------------ levels

    def level(self, i: int) -> DataFrame:
        """Nodes of level i >= 1: parent key (px, py), own key, count and box."""
        (sx, sy), (ux, uy) = self.grid.shifts[i], self.grid.shifts[i - 1]
        nodes = self.pyramid.filter(F.col("level") == i).select(
            F.shiftright("nx", ux - sx).alias("px"),
            F.shiftright("ny", uy - sy).alias("py"),
            *[F.col(k).alias(f"node_{k}") for k in ("nx", "ny", "n", *BOX)],
        )
        return bounded_broadcast(nodes, 2 ** (STEP_BITS * (i + 1)))

    def top_nodes(self) -> Column:
        """The coarsest level as an array literal."""
        rows = [
            f"named_struct('node_nx', {nx}, 'node_ny', {ny}, 'node_n', {n}L, "
            + ", ".join(f"'node_{b}', {double_text(v)}" for b, v in zip(BOX, box))
            + ")"
            for nx, ny, n, *box in self.top
        ]
        fields = ", ".join(["node_nx int", "node_ny int", "node_n bigint", *[f"node_{b} double" for b in BOX]])
        return F.expr(f"cast(array({', '.join(rows)}) as array<struct<{fields}>>)")

    # ------------------------------------------------------------ descent

    def descend(
        self, queries: DataFrame, state: Callable[[tuple[Column, ...]], Column], settle: bool,
        clip: dict[str, Callable[[tuple[Column, ...]], Column]] | None = None, settle_to: int | None = None,
        rows: int | None = None,
    ) -> DataFrame:
        """Pair every query with pyramid nodes that meet it.

        ``state`` classifies a query row against a node box as DISJOINT, BORDER or COVERED. Returns the query
        columns plus ``nx, ny, n, covered``. With ``settle`` a covered node of any level stays as it is (its
        count settles it) and the rest are cells of the finest level. Without, all rows are finest cells and
        ``covered`` only says that their points need no test.

        ``clip`` gives for a query column the part of its value that matters in a node's box. It is applied at
        every level to border pairs; a covered pair keeps an empty array.

        ``settle_to`` settles nodes down to that level only and adds the ``level`` of every row: a node that is
        covered first below it goes on to its cells.

        ``rows`` ends the walk at parts instead of cells: the coarsest nodes that hold ``rows`` points or fewer, so
        that a pair is worth a bounded amount of points and not a cell of a table of any size. It adds the ``level``
        too; ``join_points`` and ``in_parts`` take the same ``rows``.
        """
        clip = clip or {}
        known_level = [] if settle_to is None and rows is None else ["level"]
        last = len(self.grid.shifts) - 1 if rows is None else self.depth(rows)
        box = tuple(F.col(f"node_{b}") for b in BOX)
        border = F.col("state") == BORDER
        kept = [
            F.when(border, clip[c](box)).otherwise(F.array().cast(queries.schema[c].dataType)).alias(c) if c in clip else F.col(c)
            for c in queries.columns
        ]
        node = [F.col(f"node_{k}").alias(k) for k in ("nx", "ny", "n")]
        # queries are small and meet many nodes: dealt to all tasks, where adaptive execution would put them into few
        frontier = (
            queries.repartition(_tasks(self.points.sparkSession)).withColumn("node", F.explode(self.top_nodes()))
            .select(*queries.columns, "node.*")
            .withColumn("state", state(box))
            .filter(F.col("state") != DISJOINT)
            .select(*kept, *node, (F.col("state") == COVERED).alias("covered"), *[F.lit(0).alias(c) for c in known_level])
        )
        for i in range(1, last + 1):
            was = F.col("covered")
            nodes = self.level(i)
            passes = F.lit(False) if not settle else was if settle_to is None else was & (F.col("level") <= settle_to)
            if rows is not None:
                passes = passes | ((F.col("n") <= rows) & F.lit(i > self.folder_level))
            depth = [F.when(passes, F.col(c)).otherwise(F.lit(i)).alias(c) for c in known_level]
            if settle or rows is not None:
                # settled rows get keys that no node has, spread so that they never meet in one task, and pass
                # through the outer join untouched
                none = F.lit(-1) - F.pmod(F.hash(*queries.columns, "nx", "ny"), F.lit(NO_NODE_KEYS))
                keys = {"px": F.when(passes, none).otherwise(F.col("nx")), "py": F.when(passes, F.lit(-1)).otherwise(F.col("ny"))}
                step = frontier.withColumns({**keys, "passes": passes}).join(nodes, ["px", "py"], "left")
                node = [F.coalesce(f"node_{k}", k).alias(k) for k in ("nx", "ny", "n")]
            else:
                step = frontier.drop("n").withColumnsRenamed({"nx": "px", "ny": "py"}).join(nodes, ["px", "py"])
                step = step.withColumn("passes", F.lit(False))
            kept_state = F.when(was, COVERED).when(F.col("passes"), BORDER)
            frontier = (
                step.withColumn("state", kept_state.otherwise(state(box)))
                .filter(F.col("state") != DISJOINT)
                .select(*kept, *node, (F.col("state") == COVERED).alias("covered"), *depth)
            )
        return frontier

    # ------------------------------------------------------------ parts

    def depth(self, rows: int) -> int:
        """The finest level that has parts of at most ``rows`` points: one below the last larger node."""
        larger = self.pyramid.filter(F.col("n") > rows).agg(F.max("level").alias("level")).first()["level"]
        return min(len(self.grid.shifts) - 1, max(self.folder_level, 0 if larger is None else larger + 1))

    def in_parts(self, points: DataFrame, rows: int) -> DataFrame:
        """Points with the node (level, nx, ny) that is their part; without coordinates they have none.

        A node above a larger one is larger still, so the larger nodes above a point tell its level."""
        out = points.withColumn("level", F.lit(self.folder_level))
        for i in range(self.folder_level, self.depth(rows)):
            sx, sy = self.grid.shifts[i]
            larger = self.pyramid.filter((F.col("level") == i) & (F.col("n") > rows)).select(
                F.col("nx").alias("__lx"), F.col("ny").alias("__ly"), F.lit(1).alias("__larger")
            )
            here = (F.shiftright("bx", sx) == F.col("__lx")) & (F.shiftright("by", sy) == F.col("__ly"))
            out = out.join(bounded_broadcast(larger, self.extent.n // max(rows, 1)), here, "left")
            out = out.withColumn("level", F.col("level") + F.coalesce("__larger", F.lit(0))).drop("__lx", "__ly", "__larger")
        return out.withColumns({n: F.expr(f"shiftright({b}, {self._shift(a)})") for n, b, a in (("nx", "bx", 0), ("ny", "by", 1))})

    def _shift(self, axis: int, level: str = "level") -> str:
        """SQL for the shift of a level."""
        return f"element_at(array({', '.join(str(s[axis]) for s in self.grid.shifts)}), {level} + 1)"

    # ------------------------------------------------------------ cell join

    def stored(self, pairs: DataFrame) -> DataFrame:
        """Write (query, cell) pairs to shared storage, spread evenly whatever cell they name.

        The join with the points is then planned from their measured size (a broadcast only when they are
        small, so that a large point table is never shuffled on a guess), no level of the descent runs twice,
        and the cells they name say what is read of the points.
        """
        return written(pairs.repartition(_tasks(pairs.sparkSession)), "pairs")

    def touched(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """The points in folders and cell ranges that ``pairs`` name: partition filters and pushed comparisons.

        What comes back to the driver is one row per folder, at most 2 ** FOLDER_BITS."""
        level = "level" if "level" in pairs.columns else str(len(self.grid.shifts) - 1)
        cells = pairs.select(*[
            F.expr(f"shiftleft({low}, {self._shift(a, level)})").alias(name)
            for name, low, a in (("x0", "nx", 0), ("x1", "nx + 1", 0), ("y0", "ny", 1), ("y1", "ny + 1", 1))
        ])
        node = _node("x0", "y0", self.grid.shifts[self.folder_level])
        spans = cells.groupBy(node.alias("node")).agg(
            F.min("x0").alias("x0"), (F.max("x1") - 1).alias("x1"), F.min("y0").alias("y0"), (F.max("y1") - 1).alias("y1")
        ).collect()
        if not spans:
            return points.filter(F.lit(False))
        low_x, high_x = min(r["x0"] for r in spans), max(r["x1"] for r in spans)
        low_y, high_y = min(r["y0"] for r in spans), max(r["y1"] for r in spans)
        here = is_one_of(NODE, sorted(r["node"] for r in spans))
        return points.filter(here & F.col("bx").between(low_x, high_x) & F.col("by").between(low_y, high_y))

    def join_points(
        self, pairs: DataFrame, test: Column | None = None, how: str = "inner", points: DataFrame | None = None,
        rows: int | None = None,
    ) -> DataFrame:
        """Equi-join stored finest-level (query, cell) pairs, or with ``rows`` the pairs of a walk that ended at such
        parts, with the points of those cells.

        ``test`` is the exact predicate. ``how`` may be ``left_semi`` or ``left_anti``, which return points; an
        anti join reads all points, since those of other cells belong to its result. The query rows of a split
        cell are repeated for each of its parts.
        """
        pts = self.points if points is None else points
        if how != "left_anti":
            pts = self.touched(pairs, pts)
        left = pairs.withColumnsRenamed({"nx": "cell_x", "ny": "cell_y"})
        on, at, finest = (F.col("bx") == F.col("cell_x")) & (F.col("by") == F.col("cell_y")), [], len(self.grid.shifts) - 1
        if rows is not None:
            pts, at = self.in_parts(pts, rows), ["level", "nx", "ny"]
            left = left.withColumnRenamed("level", "cell_level")
            on = (F.col("level") == F.col("cell_level")) & (F.col("nx") == F.col("cell_x")) & (F.col("ny") == F.col("cell_y"))
        if self.hot is not None:
            here = (F.col("cell_x") == F.col("hx")) & (F.col("cell_y") == F.col("hy"))
            if rows is not None:
                here = here & (F.col("cell_level") == finest)
                pts = pts.withColumn(SALT, F.when(F.col("level") == finest, F.col(SALT)).otherwise(0))
            parts = F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)
            left = left.join(self.hot.drop("single"), here, "left").withColumn("cell_salt", F.explode(parts))
            left = left.drop("hx", "hy", "splits")
            on = on & (F.col(SALT) == F.col("cell_salt"))
        if test is not None:
            on = on & test
        return pts.join(left, on, how).drop("cell_level", "cell_x", "cell_y", "cell_salt", *at, *PLACED)

    def join_part_rows(self, pairs: DataFrame, test: Column, rows: int, points: DataFrame | None = None) -> DataFrame:
        """The rows of ``join_points`` for large batches, whose pairs come of a walk that ended at parts of ``rows`` points.

        The points of a part lie in one row, as an array per column, so a pair meets one row and not ``rows`` of them:
        what is sorted and shuffled are pairs and parts, and the rows of the result are made last, by unpacking the part
        beside its pair. A covered pair tests nothing. A part of more points, which is one place, is several blocks and
        its pairs are repeated for each; a part that is asked much is copied, and its pairs are dealt to the copies.
        """
        node, task = ["level", "nx", "ny"], ["__part", "__block", "__deal"]
        asked = written(pairs.groupBy(*node).agg(F.sum("n").alias("work"), F.max("n").alias("held")), "asked-parts")
        total = asked.agg(F.count(F.lit(1)).alias("parts"), F.sum("work").alias("work")).first()
        share = max(LEAST_SHARE, min(MOST_SHARE, (total["work"] or 0) // (2 * _tasks(pairs.sparkSession))))
        blocks, copies = F.ceil(F.col("held") / rows), F.ceil(F.col("work") / share)
        # a number of its own for a part: of the columns of a node, one that has a single value would be left out as a key
        dealt = written(asked.select(
            *node, F.monotonically_increasing_id().alias("__part"), blocks.cast("int").alias("__blocks"),
            F.ceil(copies / blocks).cast("int").alias("__copies"),
        ), "dealt-parts")
        keys = dealt.agg(F.sum(F.col("__blocks") * F.col("__copies")).alias("n")).first()["n"] or 1
        tasks = min(MAX_DEALS, keys, max(_tasks(pairs.sparkSession), math.ceil((total["work"] or 0) / MOST_SHARE)))
        dealt = bounded_broadcast(dealt, total["parts"])

        def each(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        pts = self.touched(pairs, self.points if points is None else points).filter("bx IS NOT NULL AND by IS NOT NULL")
        own = [c for c in pts.columns if c not in PLACED]
        pts = self.in_parts(pts, rows).join(dealt, node).withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
        packed = pts.groupBy("__part", "__block").agg(F.first("__copies").alias("__copies"), F.collect_list(F.struct(*own)).alias("__rows"))
        packed = packed.select("__part", "__block", each("__copies").alias("__deal"), "__rows").repartition(tasks, *task)
        packed = packed.select(*task, *[F.col("__rows")[c].alias(c) for c in own])

        left = pairs.drop("n").join(dealt, node).withColumn("__block", each("__blocks"))
        left = left.withColumn("__deal", F.pmod(F.xxhash64(*[c for c in pairs.columns if c not in (*node, "n", "covered")]), F.col("__copies")).cast("int"))
        left = left.drop("__blocks", "__copies", *node).repartition(tasks, *task)
        kept = [c for c in left.columns if c not in task]
        # merged from the side of the pairs: were these broadcast, one part would make the rows of all its pairs at once
        found = left.join(packed.hint("merge"), task).select(*kept, *own, F.posexplode("x").alias("__at", "__x"))
        unpacked = [F.col("__x").alias("x") if c == "x" else F.get(c, F.col("__at")).alias(c) for c in own]
        return found.select(*unpacked, *kept).filter(F.col("covered") | test).drop("covered")

    def split_single_locations(self) -> tuple[DataFrame, DataFrame | None]:
        """(ordinary points, points of split cells that are one single location or None)."""
        if self.hot is None:
            return self.points, None
        return self.points.filter(~F.col(SINGLE)), self.points.filter(SINGLE)


def _node(bx: str, by: str, shift: tuple[int, int]) -> Column:
    """Folder number of a cell; levels that make folders have at most FOLDER_BITS bits in all."""
    return F.shiftright(bx, shift[0]) * 2**FOLDER_BITS + F.shiftright(by, shift[1])


def _folder_level(shifts: tuple[tuple[int, int], ...], n: int, rows_per_folder: int) -> int:
    """The finest level whose nodes hold ``rows_per_folder`` rows on average."""
    level = 0
    while level + 1 < len(shifts) and STEP_BITS * (level + 2) <= FOLDER_BITS and n >= rows_per_folder * 2 ** (STEP_BITS * (level + 2)):
        level += 1
    return level


def _store(placed: DataFrame, grid: RankGrid | NestedGrid, n: int, level: int, hot: DataFrame | None) -> DataFrame:
    """Write points in folders by node. Ranges of (node, finer nodes, id) are even even where a cell is hot,
    so no task takes more than its share, and a file holds neighbouring cells."""
    out = placed.withColumn(NODE, _node("bx", "by", grid.shifts[level]))
    if hot is None:
        out = out.withColumns({SALT: F.lit(0), SINGLE: F.lit(False)})
    else:
        out = out.join(hot, (F.col("bx") == F.col("hx")) & (F.col("by") == F.col("hy")), "left").withColumns({
            SALT: F.pmod(F.xxhash64("id"), F.coalesce("splits", F.lit(1))).cast("int"),
            SINGLE: F.coalesce("single", F.lit(False)),
        }).drop("hx", "hy", "splits", "single")
    inner = [k for sx, sy in grid.shifts[level + 1 :] for k in (F.shiftright("bx", sx), F.shiftright("by", sy))]
    files = max(1, math.ceil(n / ROWS_PER_FILE), min(_tasks(placed.sparkSession), math.ceil(n / MIN_ROWS_PER_FILE)))
    keys = [F.col(NODE), *inner, F.col("bx"), F.col("by")]
    spread = out.repartitionByRange(files, *keys, F.col("id")).sortWithinPartitions(*keys)
    return written(spread, "points", partition_by=NODE)
