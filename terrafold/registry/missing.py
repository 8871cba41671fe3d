"""Rows with null, NaN and infinite coordinates and null groups: they are missing, and shift nothing else."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import cells, diagnostics, joins, prepare, profile
from terrafold.plans.extent import Extent, extent
from terrafold.plans.ordering import exact_quantiles, number_rows
from terrafold.plans.pyramid import PointIndex
from terrafold.registry import core
from terrafold.registry.core import PTS, WINDOWS, built, query

# Every coordinate rule hits rows of its own; a group is null for every fifth id.
WILD = f"""{PTS}, raw AS (
  SELECT id, CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 83 = 0 THEN CAST('Infinity' AS DOUBLE)
                  WHEN id % 79 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE x END AS x,
         CASE WHEN id % 101 = 0 THEN NULL WHEN id % 73 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN id % 71 = 0 THEN CAST('NaN' AS DOUBLE) ELSE y END AS y,
         CASE WHEN id % 5 > 0 THEN id % 5 END AS grp FROM pts),
wild AS (SELECT id, grp, CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(y) THEN y END AS y, x AS raw_x FROM raw),
ext AS (SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM wild)"""


def wild(spark, sf):
    i, inf, nan = F.col("id"), F.lit(float("inf")), F.lit(float("nan"))
    x = F.when(i % 97 == 0, None).when(i % 89 == 0, nan).when(i % 83 == 0, inf).when(i % 79 == 0, -inf).otherwise(F.col("x"))
    y = F.when(i % 101 == 0, None).when(i % 73 == 0, inf).when(i % 71 == 0, nan).otherwise(F.col("y"))
    return core.pts(spark, sf).select("id", x.alias("x"), y.alias("y"), F.when(i % 5 > 0, i % 5).alias("grp"))


def ext(spark, sf) -> Extent:
    return built(spark, sf, "wild-extent", lambda: Extent.of(wild(spark, sf)))


@query("wild_extent", f"WITH {WILD} SELECT n, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y FROM ext")
def wild_extent(spark, sf):
    return extent(wild(spark, sf))


@query(
    "wild_normalized",
    f"""WITH {WILD} SELECT id, round((x - x0) / (x1 - x0), 9) AS x, round((y - y0) / (y1 - y0), 9) AS y
    FROM wild CROSS JOIN ext WHERE x IS NOT NULL AND y IS NOT NULL""",
)
def wild_normalized(spark, sf):
    scaled = prepare.minmax_normalize(prepare.drop_missing(wild(spark, sf)), ext(spark, sf))
    return scaled.select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(
    "wild_stripes",
    f"""WITH {WILD}, s AS (SELECT id, CAST(floor((x - x0) / ((x1 - x0) / 1000)) AS INTEGER) AS stripe FROM wild CROSS JOIN ext)
    SELECT id, stripe, CAST(stripe % 100 AS INTEGER) AS cell_id FROM s""",
)
def wild_stripes(spark, sf):
    return cells.fixed_stripes(wild(spark, sf), ext(spark, sf)).select("id", "stripe", "cell_id")


@query(
    "wild_grid",
    f"""WITH {WILD} SELECT id, CAST(floor((x - x0) / ((x1 - x0) / 8)) - CAST(x = x1 AS INTEGER) + (floor((y - y0) / ((y1 - y0) / 8)) - CAST(y = y1 AS INTEGER)) * 8 AS INTEGER) AS cell_id
    FROM wild CROSS JOIN ext""",
)
def wild_grid(spark, sf):
    out = cells.grid_cells(wild(spark, sf), 8, ext=ext(spark, sf))
    return out.select("id", "cell_id")


@query(
    "wild_density",
    f"""WITH {WILD}, c AS (SELECT CAST(floor((x - x0) / ((x1 - x0) / 8)) - CAST(x = x1 AS INTEGER) AS INTEGER) AS cx,
      CAST(floor((y - y0) / ((y1 - y0) / 8)) - CAST(y = y1 AS INTEGER) AS INTEGER) AS cy FROM wild CROSS JOIN ext)
    SELECT CAST(a.i AS INTEGER) AS cx, CAST(b.i AS INTEGER) AS cy, count(c.cx) AS n
    FROM range(8) a(i) CROSS JOIN range(8) b(i) LEFT JOIN c ON c.cx = a.i AND c.cy = b.i GROUP BY 1, 2""",
)
def wild_density(spark, sf):
    return profile.grid_density(wild(spark, sf), 8, ext(spark, sf))


@query(
    "wild_quad_cells",
    f"""WITH {WILD}, s AS (SELECT id, CAST(floor((x - x0) / (x1 - x0 + CAST(0.01 AS DOUBLE)) * 16) AS BIGINT) AS qx,
      CAST(floor((y - y0) / (y1 - y0 + CAST(0.01 AS DOUBLE)) * 16) AS BIGINT) AS qy FROM wild CROSS JOIN ext)
    SELECT id, {" || ".join(f"CAST((1 - ((qy >> {3 - i}) & 1)) * 2 + ((qx >> {3 - i}) & 1) AS VARCHAR)" for i in range(4))} AS code FROM s""",
)
def wild_quad_cells(spark, sf):
    return cells.quad_codes(wild(spark, sf), 4, ext(spark, sf)).select("id", "code")


@query(
    "wild_kd_cells",
    f"""WITH {WILD}, k AS (SELECT * FROM wild WHERE x IS NOT NULL AND y IS NOT NULL),
    mx AS (SELECT quantile_cont(x, 0.5) AS m FROM k), half AS (SELECT k.*, CAST(x >= m AS INTEGER) AS node FROM k CROSS JOIN mx),
    my AS (SELECT node, quantile_cont(y, 0.5) AS m FROM half GROUP BY node),
    c AS (SELECT id, CAST(h.node * 2 + CAST(y >= m AS INTEGER) AS INTEGER) AS cell_id FROM half h JOIN my ON h.node = my.node)
    SELECT wild.id, c.cell_id FROM wild LEFT JOIN c ON c.id = wild.id""",
)
def wild_kd_cells(spark, sf):
    return cells.kd_tree_cells(wild(spark, sf), 4, ext(spark, sf), exact=True).select("id", "cell_id")


@query(
    "wild_tile_boxes",
    f"""WITH {WILD}, k AS (SELECT * FROM wild WHERE x IS NOT NULL AND y IS NOT NULL),
    s AS (SELECT *, ntile(4) OVER (ORDER BY x, y) - 1 AS slice FROM k),
    t AS (SELECT *, CAST(slice * 4 + ntile(4) OVER (PARTITION BY slice ORDER BY y, x) - 1 AS INTEGER) AS box_id FROM s)
    SELECT box_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM t GROUP BY box_id""",
)
def wild_tile_boxes(spark, sf):
    return cells.sort_tile_boxes(wild(spark, sf), 16, ext(spark, sf))


@query(
    "wild_cell_boxes",
    f"""WITH {WILD}, c AS (SELECT x, y, CAST(floor((x - x0) / ((x1 - x0) / 8)) - CAST(x = x1 AS INTEGER) + (floor((y - y0) / ((y1 - y0) / 8)) - CAST(y = y1 AS INTEGER)) * 8 AS INTEGER) AS cell_id
      FROM wild CROSS JOIN ext)
    SELECT cell_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM c GROUP BY cell_id""",
)
def wild_cell_boxes(spark, sf):
    assigned = cells.grid_cells(wild(spark, sf), 8, ext=ext(spark, sf))
    return diagnostics.cells_table(assigned).drop("area", "single_location")


@query(
    "wild_window_counts",
    f"""WITH {WILD}, {WINDOWS} SELECT w.qid, count(p.id) AS n FROM windows w
    LEFT JOIN wild p ON p.x BETWEEN w.min_x AND w.max_x AND p.y BETWEEN w.min_y AND w.max_y GROUP BY w.qid""",
)
def wild_window_counts(spark, sf):
    index = built(spark, sf, "wild-index", lambda: PointIndex.build(wild(spark, sf)))
    return joins.window_counts(index, core.windows(spark, sf)).select("qid", "n")


@query(
    "wild_group_numbers",
    f"""WITH {WILD} SELECT id, CAST(row_number() OVER (PARTITION BY grp ORDER BY x NULLS FIRST, id) - 1 AS BIGINT) AS row_no FROM wild""",
)
def wild_group_numbers(spark, sf):
    rows = wild(spark, sf).withColumn("x", F.when(prepare.finite("x"), F.col("x")))
    return number_rows(rows, ["x", "id"], by=["grp"]).select("id", "row_no")


@query(
    "wild_group_medians",
    f"WITH {WILD} SELECT grp, round(quantile_cont(x, 0.5), 6) AS median FROM wild GROUP BY grp",
)
def wild_group_medians(spark, sf):
    known = wild(spark, sf).filter(prepare.finite("x"))
    return exact_quantiles(known, "x", [0.5], by=["grp"]).select("grp", F.round("value", 6).alias("median"))
