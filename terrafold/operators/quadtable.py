"""An adaptive quad tree whose leaves are a table: for trees of too many leaves to be literals in a plan.

It splits the same zones as ``cells.QuadTree`` and numbers its leaves the same way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import codes
from terrafold.functions import geometry as g
from terrafold.operators.cells import default_cells
from terrafold.plans.extent import Extent
from terrafold.plans.ordering import Cuts, add_buckets, number_rows
from terrafold.plans.pyramid import BOX, BROADCAST_CUTS, beside, count_at_most
from terrafold.plans.session import bounded_broadcast, written

LEVELS_PER_ROUND = 4
LEAVES_PER_BUCKET = 4_096


@dataclass(frozen=True)
class QuadTable:
    """Leaves (cell_id, start, level, n) in Z-order; a leaf holds the quad numbers from its start to the next one's."""

    ext: Extent
    depth: int
    leaves: DataFrame
    n_leaves: int

    @classmethod
    def fit(
        cls, points: DataFrame, cells: int | None = None, depth: int | None = None, ext: Extent | None = None,
        cap: int | None = None,
    ) -> QuadTable:
        """Split every zone of more than ``cap`` points, down to ``depth``.

        The points are aggregated once at the finest depth. A round counts the zones of a few levels and passes on
        only what lies in zones that were split on its last one; all of it stays in tables.
        """
        e = ext or Extent.of(points)
        want = cells or default_cells(e.n)
        depth = codes.check_depth(depth or min(codes.MAX_DEPTH, math.ceil(math.log(max(want, 4), 4)) + 5))
        limit = cap or max(1, e.n // want)
        # the missing number is dropped from the written counts: a filter on the points would repeat the slots per digit
        open_ = written(codes.add_quad_number(points, e, depth).groupBy("quad").agg(F.count(F.lit(1)).alias("c")), "quad-finest")
        open_ = open_.filter("quad IS NOT NULL")
        rounds = []
        for low in range(0, depth + 1, LEVELS_PER_ROUND):
            last = min(low + LEVELS_PER_ROUND - 1, depth)
            level = F.explode(F.array(*[F.lit(i) for i in range(low, last + 1)])).alias("level")
            node = F.expr(f"shiftright(quad, cast(2 * ({depth} - level) as int))")
            counted = open_.select("quad", "c", level).groupBy("level", node.alias("node")).agg(F.sum("c").alias("n"))
            rounds.append(written(counted, "quad-zones"))
            full = rounds[-1].filter((F.col("n") > limit) & (F.col("level") == last) & F.lit(last < depth)).select("node")
            found = full.count()
            if not found:
                break
            under = open_.withColumn("node", F.shiftright("quad", 2 * (depth - last)))
            open_ = written(under.join(bounded_broadcast(full, found), "node", "left_semi").select("quad", "c"), "quad-open")
        zones = rounds[0]
        for more in rounds[1:]:
            zones = zones.unionByName(more)
        split = zones.filter((F.col("n") > limit) & (F.col("level") < depth)).select("level", "node")
        quarters = split.withColumn("q", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
            (F.col("level") + 1).alias("level"), (F.col("node") * 4 + F.col("q")).alias("node")
        )
        root = points.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("node"))
        ends = root.unionByName(quarters).join(split, ["level", "node"], "left_anti").join(zones, ["level", "node"], "left")
        start = F.expr(f"shiftleft(node, cast(2 * ({depth} - level) as int))")
        found = written(ends.select(start.alias("start"), "level", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")), "quad-leaves")
        n = found.count()
        leaves = written(number_rows(found, ["start"], "cell_id", n=n).withColumn("cell_id", F.col("cell_id").cast("int")), "quad-table")
        return cls(e, depth, leaves, n)

    def assign(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """Leaf number of every point; null outside the fitted extent.

        Every LEAVES_PER_BUCKET-th start is a cut on the driver; the starts between two cuts are one sorted array, in
        which the point's leaf is found by binary search.
        """
        at = F.floor(F.col("cell_id") / LEAVES_PER_BUCKET).cast("int")
        marks = self.leaves.filter(F.col("cell_id") % LEAVES_PER_BUCKET == 0).select("start").collect()
        cuts = Cuts(tuple(sorted(float(r["start"]) for r in marks))[1:])
        starts = self.leaves.groupBy(at.alias("__bucket")).agg(F.sort_array(F.collect_list("start")).alias("__starts"))
        placed = add_buckets(codes.add_quad_number(points, self.ext, self.depth, "__quad", x, y), __bucket=("__quad", cuts))
        joined = beside(placed, starts, self.n_leaves <= BROADCAST_CUTS, "left", on=("__bucket",))
        inside = count_at_most("__starts", F.col("__quad"), LEAVES_PER_BUCKET.bit_length())
        number = F.when(F.col("__quad").isNotNull(), (F.col("__bucket") * LEAVES_PER_BUCKET + inside - 1).cast("int"))
        names = [c for c in points.columns if c != "cell_id"]
        return joined.select(*names, number.alias("cell_id"))

    def zones(self) -> DataFrame:
        """(zone_id, code, level, n, box) of all leaves; boxes are half-open tiles of the padded extent."""
        low = F.sequence(F.lit(0), F.lit(self.depth - 1))
        number = F.expr(f"shiftright(start, cast(2 * ({self.depth} - level) as int))")

        def side(upper: bool):
            def bit(acc, i):
                digit = F.floor(F.col("__node") / F.pow(F.lit(4.0), i)) % 4
                b = (1 - F.floor(digit / 2)) if upper else digit % 2
                return acc + F.when(i < F.col("level"), b.cast("bigint") * F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

            return F.aggregate(low, F.lit(0).cast("bigint"), bit)

        w = F.lit(self.ext.width + codes.EDGE_PAD) / F.pow(F.lit(2.0), F.col("level"))
        h = F.lit(self.ext.height + codes.EDGE_PAD) / F.pow(F.lit(2.0), F.col("level"))
        placed = self.leaves.withColumn("__node", number).withColumns({"__col": side(False), "__row": side(True)})
        x0, y0 = F.lit(self.ext.min_x) + F.col("__col") * w, F.lit(self.ext.min_y) + F.col("__row") * h
        code = F.substring(codes.quad_text(F.col("start"), self.depth), F.lit(1), F.col("level"))
        return placed.select(
            F.col("cell_id").alias("zone_id"), code.alias("code"), "level", "n",
            x0.alias("min_x"), y0.alias("min_y"), (x0 + w).alias("max_x"), (y0 + h).alias("max_y"),
        )

    def zones_for_window(self, window: tuple[float, float, float, float]) -> DataFrame:
        return self.zones().filter(g.boxes_intersect(window, BOX))
