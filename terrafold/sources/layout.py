"""Clustered layout: points in one folder per cell, in order inside it, with a small table of cells beside them.

The cells table answers which folders a query can touch before any point is read; inside the folders, sorted files
let Parquet statistics skip files, row groups and pages. Sorted by y, that works along one axis. In Z-order
neighbours on both axes are near each other, so a window reads few files and pages of a cell of very many rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions import codes
from terrafold.functions import geometry as g
from terrafold.functions.literals import is_one_of
from terrafold.operators import diagnostics, distance, lookup, nearest
from terrafold.plans.extent import Extent
from terrafold.plans.pyramid import BOX, merged_box_aggregates
from terrafold.plans.session import BROADCAST_ROWS, bounded_broadcast, local_copy

ROWS_PER_FILE = 5_000_000
MAX_LITERAL_CELLS = 1_000


def write_clustered(assigned: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, order: str = "y") -> None:
    """Write points that carry ``cell_id``, in ``order`` "y" or "z" inside a cell.

    Tasks take ranges of (cell, order, id), so a cell above ``rows_per_file`` is spread over several tasks, also where
    it is a single place, and their files hold disjoint ranges of the order.
    """
    if order not in ("y", "z"):
        raise ValueError(f"order must be y or z, got {order!r}")
    diagnostics.cells_table(assigned).write.parquet(f"{path}/cells")
    stored = assigned.sparkSession.read.parquet(f"{path}/cells")
    size = stored.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), *merged_box_aggregates()[1:]).first()
    tasks = max(1, size["cells"] + (size["n"] or 0) // rows_per_file)
    out, keys = assigned, ["y", "x", "id"]
    if order == "z":
        box = [0.0 if size[b] is None else size[b] for b in BOX]
        out, keys = codes.add_quad_number(assigned, Extent(size["n"] or 0, *box), codes.MAX_DEPTH, "__z"), ["__z", "y", "x", "id"]
    # the writer groups by cell_id, so the order must begin with it
    placed = out.repartitionByRange(tasks, "cell_id", *keys).sortWithinPartitions("cell_id", *keys).drop("__z")
    placed.write.partitionBy("cell_id").parquet(f"{path}/points")


@dataclass
class ClusteredPoints:
    """Queries over a written layout. Same results as on the raw table, fewer cells read."""

    points: DataFrame
    cells: DataFrame
    n_cells: int

    @classmethod
    def read(cls, spark: SparkSession, path: str, schema: T.StructType) -> ClusteredPoints:
        points = spark.read.schema(schema).parquet(f"{path}/points")
        cells = spark.read.parquet(f"{path}/cells")
        n = cells.count()
        return cls(points, local_copy(cells, n), n)

    @classmethod
    def write(cls, assigned: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, order: str = "y") -> ClusteredPoints:
        write_clustered(assigned, path, rows_per_file, order)
        return cls.read(assigned.sparkSession, path, assigned.schema)

    @property
    def is_local(self) -> bool:
        return self.n_cells <= BROADCAST_ROWS

    def _prune(self, cells: DataFrame) -> DataFrame:
        """Keep the points of these cells: a literal partition filter when the cells table is local or the hits
        are few, else a semi join with the stored cells table, which prunes folders at run time."""
        ids = cells.select("cell_id")
        return self._keep([r[0] for r in (ids if self.is_local else ids.limit(MAX_LITERAL_CELLS + 1)).collect()], ids)

    def _keep(self, ids: list[int], cells: DataFrame) -> DataFrame:
        if self.is_local or len(ids) <= MAX_LITERAL_CELLS:
            return self.points.filter(is_one_of("cell_id", ids))
        return self.points.join(bounded_broadcast(cells, self.n_cells), "cell_id", "left_semi")

    def _hit(self, window) -> Column:
        return g.boxes_intersect(window, BOX)

    def point_lookup(self, qx: float, qy: float, distinct: bool = False) -> DataFrame:
        held = self.cells.filter(g.box_contains_point(*BOX, qx, qy))
        return lookup.point_lookup(self._prune(held), qx, qy, distinct).drop("cell_id")

    def range_query(self, window: tuple[float, float, float, float]) -> DataFrame:
        return lookup.range_query(self._prune(self.cells.filter(self._hit(window))), window).drop("cell_id")

    def range_count(self, window: tuple[float, float, float, float]) -> DataFrame:
        """Whole cells are counted from the cells table; only border cells are read."""
        inside = g.box_contains_box(window, BOX)
        proper = F.lit(window[0] <= window[2] and window[1] <= window[3])
        hit = self.cells.filter(self._hit(window) & proper).select("cell_id", "n", inside.alias("whole"))
        border = lookup.range_query(self._prune(hit.filter(~F.col("whole"))), window)
        if self.is_local:
            known = sum(r["n"] for r in hit.filter("whole").collect())
            return border.agg((F.count(F.lit(1)) + F.lit(known)).cast("bigint").alias("n"))
        parts = hit.filter("whole").select("n").unionByName(border.agg(F.count(F.lit(1)).alias("n")))
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))

    def circle_query(self, cx: float, cy: float, r: float) -> DataFrame:
        near = self.cells.filter(g.box_min_distance(BOX, cx, cy) <= F.lit(float(r)))
        return lookup.circle_query(self._prune(near), cx, cy, r).drop("cell_id")

    def distance_query(self, lat: float, lon: float, metres: float) -> DataFrame:
        """Points (x longitude, y latitude, degrees) within ``metres``; cells that begin farther away are not read."""
        near, _ = g.haversine_bounds(BOX, lat, lon)
        kept = self._prune(self.cells.filter(near <= F.lit(float(metres))))
        return distance.distance_query(kept, lat, lon, metres, "y", "x").drop("cell_id")

    def knn(self, qx: float, qy: float, k: int) -> DataFrame:
        """Exact kNN that reads only cells that can hold a result.

        Cells by farthest corner give a radius that surely covers k points; cells that begin beyond it are out.
        """
        ranged = self.cells.select(
            "cell_id", "n", g.box_min_distance(BOX, qx, qy).alias("near"), g.box_max_distance(BOX, qx, qy).alias("far")
        )
        if not self.is_local:
            return nearest.knn(self._prune(nearest.cells_within_reach(ranged, k)), qx, qy, k).drop("cell_id")
        rows = sorted(ranged.collect(), key=lambda r: r["far"])
        held, reach = 0, math.inf
        for r in rows:
            held += r["n"]
            if held >= k:
                reach = r["far"]
                break
        within = ranged.filter(F.col("near") <= F.lit(reach)).select("cell_id")
        kept = self._keep([r["cell_id"] for r in rows if r["near"] <= reach], within)
        return nearest.knn(kept, qx, qy, k).drop("cell_id")

    def pruning_report(self, window: tuple[float, float, float, float]) -> DataFrame:
        return diagnostics.pruning_report(self.cells, window)
