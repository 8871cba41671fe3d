"""Cell assignment and partition diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import cells, diagnostics
from terrafold.operators.quadtable import QuadTable
from terrafold.plans.session import scratch_path
from terrafold.registry import core
from terrafold.registry.core import EXT, PTS, grid_sql, query
from terrafold.registry.filters import WINDOW
from terrafold.sources import sinks


def r6(c):
    return F.round(c, 6)


def _stripes_sql(step: str) -> str:
    return f"""WITH {EXT}, s AS (SELECT id, CAST(floor((x - x0) / ({step})) AS INTEGER) AS stripe FROM pts CROSS JOIN ext)
    SELECT id, stripe, CAST(stripe % 100 AS INTEGER) AS cell_id FROM s"""


@query("fixed_stripes", _stripes_sql("(x1 - x0) / 1000"))
def fixed_stripes(spark, sf):
    return cells.fixed_stripes(core.pts(spark, sf), core.ext(spark, sf)).select("id", "stripe", "cell_id")


@query("adaptive_stripes", _stripes_sql("(x1 - x0) / (n / CAST(least(100, n) AS DOUBLE))"))
def adaptive_stripes(spark, sf):
    return cells.adaptive_stripes(core.pts(spark, sf), core.ext(spark, sf)).select("id", "stripe", "cell_id")


@query("grid_cells", f"WITH {grid_sql(16, 8)} SELECT id, cell_id FROM cells")
def grid_cells(spark, sf):
    return cells.grid_cells(core.pts(spark, sf), 16, 8, core.ext(spark, sf)).select("id", "cell_id")


def quad_sql(depth: int) -> str:
    """CTE ``quads``: pts with the digit string at a depth."""
    digits = " || ".join(
        f"CAST((1 - ((qy >> {depth - lv}) & 1)) * 2 + ((qx >> {depth - lv}) & 1) AS VARCHAR)" for lv in range(1, depth + 1)
    )
    return f"""{EXT}, slots AS (
      SELECT id, x, y, CAST(floor((x - x0) / (x1 - x0 + CAST(0.01 AS DOUBLE)) * {2**depth}) AS BIGINT) AS qx,
                 CAST(floor((y - y0) / (y1 - y0 + CAST(0.01 AS DOUBLE)) * {2**depth}) AS BIGINT) AS qy FROM pts CROSS JOIN ext),
    quads AS (SELECT id, x, y, {digits} AS code FROM slots)"""


@query("quad_code", f"WITH {quad_sql(8)} SELECT id, code FROM quads")
def quad_code(spark, sf):
    return cells.quad_codes(core.pts(spark, sf), 8, core.ext(spark, sf)).select("id", "code")


@query(
    "quad_rollup",
    f"""WITH {quad_sql(5)} SELECT CAST(l AS INTEGER) AS level, substr(code, 1, l) AS code, count(*) AS n
    FROM quads CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS v(l) GROUP BY l, substr(code, 1, l)""",
)
def quad_rollup(spark, sf):
    return cells.quad_rollup(core.pts(spark, sf), 5, core.ext(spark, sf))


DEPTH, TREE_CELLS = 7, 64
TREE_SQL = f"""{quad_sql(DEPTH)}, nodes AS (
      SELECT substr(code, 1, l) AS node, l, count(*) AS n FROM quads CROSS JOIN range({DEPTH + 1}) AS v(l) GROUP BY 1, 2),
    splits AS (SELECT node, l FROM nodes CROSS JOIN ext WHERE nodes.n > greatest(1, ext.n // {TREE_CELLS}) AND l < {DEPTH}),
    children AS (SELECT s.node || d.digit AS node, s.l + 1 AS l FROM splits s CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('3')) d(digit)),
    leaves AS (
      SELECT c.node AS code, CAST(c.l AS INTEGER) AS level, coalesce(k.n, 0) AS n FROM children c
      LEFT JOIN nodes k ON k.node = c.node AND k.l = c.l
      WHERE NOT EXISTS (SELECT 1 FROM splits s WHERE s.node = c.node AND s.l = c.l)),
    zones AS (
      SELECT *, CAST(row_number() OVER (ORDER BY rpad(code, {DEPTH}, '0'), level) - 1 AS INTEGER) AS zone_id FROM leaves)"""


def _tree(spark, sf):
    return core.built(
        spark, sf, "quad_tree",
        lambda: cells.QuadTree.fit(core.pts(spark, sf), TREE_CELLS, DEPTH, core.ext(spark, sf)),
    )


@query("quad_leaves", f"WITH {TREE_SQL} SELECT zone_id, code, level, n FROM zones")
def quad_leaves(spark, sf):
    # fitted afresh, so that the query measures the fit
    tree = cells.QuadTree.fit(core.pts(spark, sf), TREE_CELLS, DEPTH, core.ext(spark, sf))
    return tree.zones(spark).select("zone_id", "code", "level", "n")


def _quad_table(spark, sf):
    fit = lambda: QuadTable.fit(core.pts(spark, sf), TREE_CELLS, DEPTH, core.ext(spark, sf))
    return core.built(spark, sf, "quad_table", fit)


@query("quad_table_leaves", f"WITH {TREE_SQL} SELECT zone_id, code, level, n FROM zones")
def quad_table_leaves(spark, sf):
    """The tree whose leaves stay a table."""
    return _quad_table(spark, sf).zones().select("zone_id", "code", "level", "n")


@query(
    "quad_table_cells",
    f"WITH {TREE_SQL} SELECT q.id, z.zone_id AS cell_id FROM quads q JOIN zones z ON substr(q.code, 1, z.level) = z.code",
)
def quad_table_cells(spark, sf):
    return _quad_table(spark, sf).assign(core.pts(spark, sf)).select("id", "cell_id")


@query(
    "quad_tree_cells",
    f"WITH {TREE_SQL} SELECT q.id, z.zone_id AS cell_id FROM quads q JOIN zones z ON substr(q.code, 1, z.level) = z.code",
)
def quad_tree_cells(spark, sf):
    return _tree(spark, sf).assign(core.pts(spark, sf)).select("id", "cell_id")


@query("quad_leaf_count", f"WITH {TREE_SQL} SELECT count(*) AS leaves, CAST(max(level) AS INTEGER) AS deepest FROM zones")
def quad_leaf_count(spark, sf):
    return _tree(spark, sf).zones(spark).agg(F.count(F.lit(1)).alias("leaves"), F.max("level").alias("deepest"))


@query(
    "zones_for_window",
    f"""WITH {TREE_SQL}, corners AS (
      SELECT zone_id, code, level,
        (SELECT CAST(sum(((ascii(substr(code, i, 1)) - 48) & 1) << (level - i)) AS BIGINT) FROM range(1, level + 1) r(i)) AS col,
        (SELECT CAST(sum((1 - ((ascii(substr(code, i, 1)) - 48) >> 1)) << (level - i)) AS BIGINT) FROM range(1, level + 1) r(i)) AS rw
      FROM zones),
    boxes AS (
      SELECT zone_id, x0 + col * ((x1 - x0 + CAST(0.01 AS DOUBLE)) / (1 << level)) AS min_x,
        x0 + col * ((x1 - x0 + CAST(0.01 AS DOUBLE)) / (1 << level)) + (x1 - x0 + CAST(0.01 AS DOUBLE)) / (1 << level) AS max_x,
        y0 + rw * ((y1 - y0 + CAST(0.01 AS DOUBLE)) / (1 << level)) AS min_y,
        y0 + rw * ((y1 - y0 + CAST(0.01 AS DOUBLE)) / (1 << level)) + (y1 - y0 + CAST(0.01 AS DOUBLE)) / (1 << level) AS max_y
      FROM corners CROSS JOIN ext)
    SELECT zone_id, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y
    FROM boxes WHERE min_x <= 150000 AND max_x >= 100000 AND min_y <= 900 AND max_y >= 500""",
)
def zones_for_window(spark, sf):
    out = _tree(spark, sf).zones_for_window(spark, WINDOW)
    return out.select("zone_id", *[r6(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(
    "zone_of_location",
    f"""WITH {TREE_SQL}, far AS (SELECT id * 2 AS id, id AS src FROM pts UNION ALL SELECT id * 2 + 1, NULL FROM pts)
    SELECT f.id, z.zone_id FROM far f LEFT JOIN quads q ON q.id = f.src
    LEFT JOIN zones z ON substr(q.code, 1, z.level) = z.code""",
)
def zone_of_location(spark, sf):
    p = core.pts(spark, sf)
    inside = p.select((F.col("id") * 2).alias("id"), "x", "y")
    outside = p.select((F.col("id") * 2 + 1).alias("id"), (F.col("x") + 1e7).alias("x"), "y")
    found = _tree(spark, sf).assign(inside.unionByName(outside))
    return found.select("id", F.col("cell_id").alias("zone_id"))


@query(
    "kd_cells_depth2_exact",
    f"""WITH {PTS}, mx AS (SELECT quantile_cont(x, 0.5) AS m FROM pts),
    half AS (SELECT p.*, CAST(x >= m AS INTEGER) AS node FROM pts p CROSS JOIN mx),
    my AS (SELECT node, quantile_cont(y, 0.5) AS m FROM half GROUP BY node)
    SELECT id, CAST(h.node * 2 + CAST(y >= m AS INTEGER) AS INTEGER) AS cell_id FROM half h JOIN my ON h.node = my.node""",
)
def kd_cells_depth2_exact(spark, sf):
    return cells.kd_tree_cells(core.pts(spark, sf), 4, core.ext(spark, sf), exact=True).select("id", "cell_id")


STR_SQL = f"""{PTS}, slices AS (SELECT *, ntile(5) OVER (ORDER BY x, y, id) - 1 AS slice FROM pts),
    tiles AS (SELECT *, CAST(slice * 4 + ntile(4) OVER (PARTITION BY slice ORDER BY y, x, id) - 1 AS INTEGER) AS cell_id FROM slices)"""


@query("str_tiles", f"WITH {STR_SQL} SELECT id, cell_id FROM tiles")
def str_tiles(spark, sf):
    return cells.sort_tiles(core.pts(spark, sf), 5, 4, core.ext(spark, sf).n).select("id", "cell_id")


@query(
    "str_boxes",
    f"""WITH {STR_SQL} SELECT cell_id AS box_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
    FROM tiles GROUP BY cell_id""",
)
def str_boxes(spark, sf):
    return cells.tile_boxes(cells.sort_tiles(core.pts(spark, sf), 5, 4, core.ext(spark, sf).n))


@query(
    "str_assign",
    f"""WITH {STR_SQL}, boxes AS (
      SELECT cell_id AS box_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM tiles GROUP BY cell_id),
    probes AS (SELECT id * 2 AS id, x, y FROM pts UNION ALL SELECT id * 2 + 1, x + 250000, y FROM pts)
    SELECT p.id, CAST(coalesce((SELECT min(box_id) FROM boxes WHERE p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y), -1)
      AS INTEGER) AS cell_id FROM probes p""",
)
def str_assign(spark, sf):
    p = core.pts(spark, sf)
    boxes = core.built(
        spark, sf, "str_boxes",
        lambda: cells.written(cells.tile_boxes(cells.sort_tiles(p, 5, 4, core.ext(spark, sf).n)), "boxes"),
    )
    here = p.select((F.col("id") * 2).alias("id"), "x", "y")
    away = p.select((F.col("id") * 2 + 1).alias("id"), (F.col("x") + 250000).alias("x"), "y")
    return cells.assign_to_boxes(here.unionByName(away), boxes).select("id", "cell_id")


# ---------------------------------------------------------------- properties of data-driven cells


def _checked(spark, sf, method, assigned, limit):
    """Loss and balance in one row; the SQL side states what must hold."""
    p = core.pts(spark, sf)
    loss = diagnostics.loss_check(p, assigned)
    sizes = diagnostics.cell_counts(assigned).agg((F.max("n") <= F.avg("n") * limit).alias("balanced"))
    return loss.select(F.lit(method).alias("method"), "n_before", "n_lost", sizes.scalar().alias("balanced"))


def _check_sql(method: str) -> str:
    return f"""WITH {PTS} SELECT '{method}' AS method, count(*) AS n_before, CAST(0 AS BIGINT) AS n_lost, true AS balanced FROM pts"""


@query("quantile_grid_check", _check_sql("quantile grid"))
def quantile_grid_check(spark, sf):
    return _checked(spark, sf, "quantile grid", cells.quantile_grid(core.pts(spark, sf), 36, core.ext(spark, sf)), 2)


@query("kd_tree_check", _check_sql("kd tree"))
def kd_tree_check(spark, sf):
    return _checked(spark, sf, "kd tree", cells.kd_tree_cells(core.pts(spark, sf), 32, core.ext(spark, sf)), 2)


@query("quad_tree_check", _check_sql("quad tree"))
def quad_tree_check(spark, sf):
    tree = cells.QuadTree.fit(core.pts(spark, sf), 32, ext=core.ext(spark, sf))
    return _checked(spark, sf, "quad tree", tree.assign(core.pts(spark, sf)), 8)


@query("sort_tile_check", _check_sql("sort tiles"))
def sort_tile_check(spark, sf):
    e = core.ext(spark, sf)
    boxes = cells.sort_tile_boxes(core.pts(spark, sf), 30, e)
    return _checked(spark, sf, "sort tiles", cells.assign_to_boxes(core.pts(spark, sf), boxes), 3)


# ---------------------------------------------------------------- diagnostics

CELLS = f"""{grid_sql(20)}, stats AS (
      SELECT cell_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
        greatest(0.0, (max(x) - min(x)) * (max(y) - min(y))) AS area FROM cells GROUP BY cell_id)"""
ALL_CELLS = f"""{CELLS}, every AS (
      SELECT coalesce(s.n, 0) AS n, coalesce(s.area, 0) AS area FROM range(420) r(i) LEFT JOIN stats s ON s.cell_id = r.i)"""
PARTITIONS = 420  # more partitions than cells, so that empty ones occur


def _cells(spark, sf):
    return diagnostics.cells_table(core.grid_assigned(spark, sf, 20))


@query(
    "cells_table",
    f"""WITH {CELLS} SELECT cell_id, n, min_x, min_y, max_x, max_y, round(area, 6) AS area,
      min_x = max_x AND min_y = max_y AS single_location FROM stats""",
)
def cells_table(spark, sf):
    return _cells(spark, sf).withColumn("area", r6("area"))


@query("cell_counts", f"WITH {CELLS} SELECT cell_id, n FROM stats")
def cell_counts(spark, sf):
    return diagnostics.cell_counts(core.grid_assigned(spark, sf, 20))


@query(
    "partition_balance",
    f"""WITH {ALL_CELLS} SELECT count(*) AS partitions, min(n) AS min_n, round(avg(n), 6) AS avg_n, max(n) AS max_n,
      count(*) FILTER (n = 0) AS empty, round(min(area), 6) AS min_area, round(avg(area), 3) AS avg_area,
      round(max(area), 6) AS max_area FROM every""",
)
def partition_balance(spark, sf):
    out = diagnostics.partition_balance(_cells(spark, sf), PARTITIONS)
    rounded = {c: r6(c) for c in ("avg_n", "min_area", "max_area")}
    return out.withColumns({**rounded, "avg_area": F.round("avg_area", 3)})


@query(
    "size_histogram",
    f"""WITH {ALL_CELLS}, k AS (SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 100 THEN '1-100' WHEN n <= 1000 THEN '101-1000'
      WHEN n <= 10000 THEN '1001-10000' ELSE '>10000' END AS bucket FROM every)
    SELECT b.bucket, count(k.bucket) AS cells FROM (VALUES ('0'), ('1-100'), ('101-1000'), ('1001-10000'), ('>10000')) b(bucket)
    LEFT JOIN k ON k.bucket = b.bucket GROUP BY b.bucket""",
)
def size_histogram(spark, sf):
    return diagnostics.size_histogram(_cells(spark, sf), PARTITIONS)


@query(
    "small_cell_ratio",
    f"""WITH {CELLS} SELECT count(*) AS non_empty, count(*) FILTER (n <= 100) AS small,
      round(count(*) FILTER (n <= 100) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM stats""",
)
def small_cell_ratio(spark, sf):
    return diagnostics.small_cell_ratio(_cells(spark, sf)).withColumn("ratio", r6("ratio"))


@query("loss_check", f"WITH {PTS} SELECT count(*) AS n_before, count(*) AS n_after, CAST(0 AS BIGINT) AS n_unplaced, CAST(0 AS BIGINT) AS n_lost FROM pts")
def loss_check(spark, sf):
    return diagnostics.loss_check(core.pts(spark, sf), core.grid_assigned(spark, sf, 20))


@query(
    "full_report",
    f"""WITH {ALL_CELLS} SELECT 'grid' AS method, 'whole' AS label, true AS timed, count(*) AS partitions, min(n) AS min_n,
      round(avg(n), 6) AS avg_n, max(n) AS max_n, count(*) FILTER (n = 0) AS empty, round(min(area), 6) AS min_area,
      round(avg(area), 3) AS avg_area, round(max(area), 6) AS max_area,
      (SELECT count(*) FROM pts) AS n_before, (SELECT count(*) FROM pts) AS n_after, CAST(0 AS BIGINT) AS n_lost,
      count(*) FILTER (n > 0) AS non_empty, count(*) FILTER (n BETWEEN 1 AND 100) AS small,
      round(count(*) FILTER (n BETWEEN 1 AND 100) / CAST(count(*) FILTER (n > 0) AS DOUBLE), 6) AS small_ratio,
      count(*) FILTER (n = 0) || ',' || count(*) FILTER (n BETWEEN 1 AND 100) || ',' || count(*) FILTER (n BETWEEN 101 AND 1000)
        || ',' || count(*) FILTER (n BETWEEN 1001 AND 10000) || ',' || count(*) FILTER (n > 10000) AS histogram FROM every""",
)
def full_report(spark, sf):
    """Every column of the report, appended to a file and read back."""
    p, path = core.pts(spark, sf), scratch_path(spark, "full-report")
    made = diagnostics.report(p, core.grid_assigned(spark, sf, 20), "grid", PARTITIONS, "whole")
    sinks.append_report(made, path, "parquet")
    out = spark.read.schema(made.schema).parquet(path)
    classes = F.transform(F.array(*[F.lit(b) for b in ("0", "1-100", "101-1000", "1001-10000", ">10000")]), lambda b: F.col("histogram")[b])
    rounded = {c: r6(c) for c in ("avg_n", "min_area", "max_area", "small_ratio")}
    return out.withColumns({
        **rounded, "avg_area": F.round("avg_area", 3), "timed": F.col("reported_at").isNotNull(),
        "histogram": F.concat_ws(",", F.transform(classes, lambda n: n.cast("string"))),
    }).drop("reported_at")


@query(
    "pruning_report",
    f"""WITH {CELLS}, h AS (SELECT *, min_x <= 150000 AND max_x >= 100000 AND min_y <= 900 AND max_y >= 500 AS hit FROM stats)
    SELECT count(*) AS cells_total, count(*) FILTER (hit) AS cells_hit, CAST(sum(n) FILTER (hit) AS BIGINT) AS rows_hit,
      CAST(sum(n) AS BIGINT) AS rows_total, round(sum(n) FILTER (hit) / CAST(sum(n) AS DOUBLE), 6) AS row_share FROM h""",
)
def pruning_report(spark, sf):
    return diagnostics.pruning_report(_cells(spark, sf), WINDOW).withColumn("row_share", r6("row_share"))


def _every_method(points):
    """Each way to give points a cell, by name."""
    tree = cells.QuadTree.fit(points, 16)
    boxes = cells.sort_tile_boxes(points, 16)
    return {
        "fixed_stripes": cells.fixed_stripes(points),
        "adaptive_stripes": cells.adaptive_stripes(points),
        "grid": cells.grid_cells(points, 4),
        "quantile_grid": cells.quantile_grid(points, 16),
        "quad_tree": tree.assign(points),
        "kd_tree": cells.kd_tree_cells(points, 16),
        "kd_tree_exact": cells.kd_tree_cells(points, 16, exact=True),
        "sort_tiles": cells.sort_tiles(points, 4, 4),
        "boxes": cells.assign_to_boxes(points, boxes),
    }


EVERY_METHOD = ("fixed_stripes", "adaptive_stripes", "grid", "quantile_grid", "quad_tree", "kd_tree", "kd_tree_exact", "sort_tiles", "boxes")
KEPT_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS method, part, count(p.id) AS n, count(p.id) AS placed FROM parts LEFT JOIN pts p ON p.id % 2 = parts.part GROUP BY part"
    for name in EVERY_METHOD
)


@query("every_method_keeps_rows", f"WITH {PTS}, parts AS (SELECT unnest([2, 1]) AS part) {KEPT_ROWS}")
def every_method_keeps_rows(spark, sf):
    """All methods on the rows of odd ids, and on a part of the table that has no rows at all."""
    out = None
    for part in (2, 1):
        for name, assigned in _every_method(core.pts(spark, sf).filter(F.col("id") % 2 == part)).items():
            counted = assigned.agg(F.count(F.lit(1)).alias("n"), F.count("cell_id").alias("placed"))
            row = counted.select(F.lit(name).alias("method"), F.lit(part).alias("part"), "n", "placed")
            out = row if out is None else out.unionByName(row)
    return out
