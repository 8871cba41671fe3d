"""Quantiles of any window from mergeable sketches that stand beside the pyramid.

Nodes of many rows keep a KLL sketch per axis; those of coarser levels are merged from them. A window merges values
that stand for equal shares of the nodes inside it; in parts that it cuts, the points are ranked once for all windows
and give such values too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators.ranges import PART_ROWS, WINDOW, marks_in_parts, merged_quantiles
from terrafold.plans.pyramid import BORDER, BOX, COVERED, DISJOINT, STEP_BITS, PointIndex
from terrafold.plans.session import written

SKETCH_K = 800
# Share of the rows by which a quantile's rank may be off, with 99 % confidence: about 2.3 / k ** 0.9, taken twice.
RANK_ERROR = 0.012
ROWS_PER_SKETCH = 65_536
MARKS = 128  # values that stand for the points of a node or part: they add half a share, 0.004, to a rank's error
AXES = ("x", "y")


@dataclass(frozen=True)
class SketchIndex:
    """Sketches (level, nx, ny, x, y) of the nodes down to level ``base`` of an index."""

    index: PointIndex
    nodes: DataFrame
    base: int
    k: int

    @classmethod
    def build(cls, index: PointIndex, k: int = SKETCH_K, rows_per_sketch: int = ROWS_PER_SKETCH) -> SketchIndex:
        """One pass over the stored points; ``base`` is the finest level of ``rows_per_sketch`` rows a node, or 0."""
        shifts, base = index.grid.shifts, 0
        while base + 1 < len(shifts) and index.extent.n >= rows_per_sketch * 2 ** (STEP_BITS * (base + 2)):
            base += 1
        (sx, sy) = shifts[base]
        placed = index.points.filter("bx IS NOT NULL AND by IS NOT NULL")
        node = [F.shiftright("bx", sx).alias("nx"), F.shiftright("by", sy).alias("ny")]
        made = [F.kll_sketch_agg_double(F.col(a).cast("double"), F.lit(k)).alias(a) for a in AXES]
        nodes = written(placed.groupBy(*node).agg(*made).withColumn("level", F.lit(base)), "sketches")
        levels = [nodes]
        for level in range(base - 1, -1, -1):
            ux, uy = shifts[level][0] - shifts[level + 1][0], shifts[level][1] - shifts[level + 1][1]
            up = [F.shiftright("nx", ux).alias("nx"), F.shiftright("ny", uy).alias("ny")]
            merged = levels[-1].groupBy(*up).agg(*[F.kll_merge_agg_double(F.col(a), F.lit(k)).alias(a) for a in AXES])
            levels.append(written(merged.withColumn("level", F.lit(level)), "sketches"))
        out = levels[0]
        for more in levels[1:]:
            out = out.unionByName(more)
        return cls(index, out, base, k)

    def window_quantiles(self, windows: DataFrame, probs: list[float], key: str = "qid") -> DataFrame:
        """Rows (key, n, x_quantiles, y_quantiles) of every closed window (key unique); n is exact, the quantiles'
        ranks are off by RANK_ERROR of n at most at the given k, nearly always. A window without points has n = 0
        and null quantiles, an inverted one holds none."""
        named = windows.select(key, *[F.col(b).cast("double").alias(w) for b, w in zip(BOX, WINDOW)])
        proper = (F.col(WINDOW[0]) <= F.col(WINDOW[2])) & (F.col(WINDOW[1]) <= F.col(WINDOW[3]))

        def state(box: tuple[Column, ...]) -> Column:
            outside = ~g.boxes_intersect(WINDOW, box)
            return F.when(outside, DISJOINT).when(g.box_contains_box(WINDOW, box), COVERED).otherwise(BORDER)

        walked = self.index.descend(named.filter(proper), state, settle=True, settle_to=self.base, rows=PART_ROWS)
        pairs = self.index.stored(walked)
        settled = F.col("covered") & (F.col("level") <= self.base)
        shares = F.array(*[F.lit((i + 0.5) / MARKS) for i in range(MARKS)])
        marks = [F.kll_sketch_get_quantile_double(F.col(a), shares).alias(a) for a in AXES]
        nodes = self.nodes.select("level", "nx", "ny", *marks)
        whole = pairs.filter(settled).select(key, "level", "nx", "ny", "n").join(nodes, ["level", "nx", "ny"]).select(key, "n", *AXES)
        cut = marks_in_parts(self.index, pairs.filter(~settled), [key], PART_ROWS, MARKS).filter("n > 0")
        values = merged_quantiles(written(whole.unionByName(cut), "window-marks"), key, probs)
        return windows.select(key).join(values, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
