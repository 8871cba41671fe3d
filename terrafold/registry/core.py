"""Registration, cached builds, and the views all queries share (Spark form and SQL form)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import cells
from terrafold.operators.prepare import minmax_normalize
from terrafold.plans.extent import Extent
from terrafold.plans.pyramid import PointIndex
from terrafold.plans.session import scratch_path
from terrafold.sources.layout import ClusteredPoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_BUILT: dict[tuple[str, str, str], Any] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement it must agree with."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def built(spark: SparkSession, sf: str, name: str, make: Callable[[], Any]) -> Any:
    """Build an index, layout or extent once per session and input folder, as a user would."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


# ---------------------------------------------------------------- views


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return built(spark, sf, f"table:{name}", lambda: spark.read.parquet(f"{sf}/{name}.parquet"))


def pts(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), days.alias("y")
    )


def ext(spark: SparkSession, sf: str) -> Extent:
    return built(spark, sf, "extent", lambda: Extent.of(pts(spark, sf)))


def unit(spark: SparkSession, sf: str) -> DataFrame:
    """pts on the unit square."""
    return minmax_normalize(pts(spark, sf), ext(spark, sf))


def geo(spark: SparkSession, sf: str) -> DataFrame:
    lat = F.lit(40.0) + F.lit(2.0) * ((F.col("user_id") * 37) % 1000) / F.lit(1000.0)
    lon = F.lit(-75.0) + F.lit(3.0) * ((F.col("event_id") * 7919) % 10007) / F.lit(10007.0)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), lat.alias("lat"), lon.alias("lon"))


def ties(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))


def emb(spark: SparkSession, sf: str) -> DataFrame:
    first = [F.col("embedding")[i].cast("double") for i in (0, 1)]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), first[0].alias("x"), first[1].alias("y")
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    x = F.when(i % 97 == 0, None).when(i % 89 == 0, 0.0).when(i % 83 == 0, 1e7).otherwise(F.col("x"))
    y = F.when(i % 97 == 0, None).when(i % 89 == 0, 0.0).otherwise(F.col("y"))
    return pts(spark, sf).select("id", x.alias("x"), y.alias("y"))


DIRTY_BOX = (0.0, 0.0, 500000.0, 2500.0)


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Query points (qid, qx, qy)."""
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("qid"),
        (1000 + (s * 4999) % 499000).cast("double").alias("qx"),
        ((s * 37) % 2405).cast("double").alias("qy"),
    )


def unit_places(spark: SparkSession, sf: str) -> DataFrame:
    return places(spark, sf).select(
        "qid", (F.col("qx") / F.lit(500000.0)).alias("qx"), (F.col("qy") / F.lit(2405.0)).alias("qy")
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.array(*[
        F.struct(F.lit(lvl).alias("lvl"), F.lit(hx).alias("hx"), F.lit(hy).alias("hy"))
        for lvl, hx, hy in ((1, 500.0, 5.0), (2, 5000.0, 50.0), (3, 25000.0, 250.0))
    ])
    rows = places(spark, sf).withColumn("l", F.explode(levels))
    return rows.select(
        (F.col("qid") * 10 + F.col("l.lvl")).alias("qid"),
        F.col("l.lvl").alias("lvl"),
        (F.col("qx") - F.col("l.hx")).alias("min_x"),
        (F.col("qy") - F.col("l.hy")).alias("min_y"),
        (F.col("qx") + F.col("l.hx")).alias("max_x"),
        (F.col("qy") + F.col("l.hy")).alias("max_y"),
    )


# The notched pentagon, as offsets from its centre.
NOTCH = ((-15000.0, -120.0), (15000.0, -120.0), (15000.0, 120.0), (0.0, 0.0), (-15000.0, 120.0))


def polys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    cx, cy = (k * 20000).cast("double"), (k * 96).cast("double")
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in NOTCH])
    return table(spark, sf, "nation").select(k.alias("poly_id"), ring.alias("ring"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return polys(spark, sf).select("poly_id", F.posexplode("ring").alias("seq", "v")).select(
        "poly_id", F.col("seq").cast("bigint").alias("seq"), "v.x", "v.y"
    )


# ---------------------------------------------------------------- builds


def index(spark: SparkSession, sf: str) -> PointIndex:
    return built(spark, sf, "index", lambda: PointIndex.build(pts(spark, sf)))


def unit_index(spark: SparkSession, sf: str) -> PointIndex:
    return built(spark, sf, "unit_index", lambda: PointIndex.build(unit(spark, sf)))


def nested_index(spark: SparkSession, sf: str) -> PointIndex:
    """Points under a grid so coarse that it is cut again inside its cells, as one grid would be beyond its limit."""
    return built(spark, sf, "nested_index", lambda: PointIndex.build(pts(spark, sf), per_cell=16, cell_bits=4))


def geo_points(spark: SparkSession, sf: str) -> DataFrame:
    return geo(spark, sf).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))


def geo_index(spark: SparkSession, sf: str) -> PointIndex:
    return built(spark, sf, "geo_index", lambda: PointIndex.build(geo_points(spark, sf)))


def geo_layout(spark: SparkSession, sf: str) -> ClusteredPoints:
    make = lambda: ClusteredPoints.write(cells.kd_tree_cells(geo_points(spark, sf)), scratch_path(spark, "geo-layout"))
    return built(spark, sf, "geo_layout", make)


# Ways to lay points out in folders; the KD tree is the default.
LAYOUTS = {
    "stripes": lambda p, e: cells.fixed_stripes(p, e).drop("stripe"),
    "adaptive_stripes": lambda p, e: cells.adaptive_stripes(p, e).drop("stripe"),
    "quantile_grid": lambda p, e: cells.quantile_grid(p, ext=e),
    "quad_tree": lambda p, e: cells.quad_tree_cells(p, ext=e),
    "sort_tiles": lambda p, e: cells.assign_to_boxes(p, cells.sort_tile_boxes(p, ext=e)),
}


def layout(spark: SparkSession, sf: str, method: str = "kd_tree") -> ClusteredPoints:
    """Points written as a clustered layout."""

    def make() -> ClusteredPoints:
        assign = LAYOUTS.get(method, lambda p, e: cells.kd_tree_cells(p, ext=e))
        return ClusteredPoints.write(assign(pts(spark, sf), ext(spark, sf)), scratch_path(spark, "layout"))

    return built(spark, sf, f"layout-{method}", make)


def grid_assigned(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return cells.grid_cells(pts(spark, sf), n, ext=ext(spark, sf))


# ---------------------------------------------------------------- SQL views

PTS = """pts AS (
  SELECT o_orderkey AS id, o_totalprice AS x,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y
  FROM orders)"""
EXT = f"""{PTS}, ext AS (
  SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts)"""
UNIT = f"""{EXT}, unit AS (
  SELECT id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM pts CROSS JOIN ext)"""
GEO = """geo AS (
  SELECT event_id AS id,
         CAST(40.0 AS DOUBLE) + CAST(2.0 AS DOUBLE) * ((user_id * 37) % 1000) / CAST(1000.0 AS DOUBLE) AS lat,
         CAST(-75.0 AS DOUBLE) + CAST(3.0 AS DOUBLE) * ((event_id * 7919) % 10007) / CAST(10007.0 AS DOUBLE) AS lon
  FROM events)"""
TIES = "ties AS (SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem)"
DIRTY = f"""{PTS}, dirty AS (
  SELECT id,
         CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN CAST(0.0 AS DOUBLE)
              WHEN id % 83 = 0 THEN CAST(1e7 AS DOUBLE) ELSE x END AS x,
         CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN CAST(0.0 AS DOUBLE) ELSE y END AS y
  FROM pts)"""
PLACES = """places AS (
  SELECT s_suppkey AS qid, CAST(1000 + (s_suppkey * 4999) % 499000 AS DOUBLE) AS qx,
         CAST((s_suppkey * 37) % 2405 AS DOUBLE) AS qy
  FROM supplier)"""
WINDOWS = f"""{PLACES}, windows AS (
  SELECT qid * 10 + lvl AS qid, CAST(lvl AS INTEGER) AS lvl,
         qx - hx AS min_x, qy - hy AS min_y, qx + hx AS max_x, qy + hy AS max_y
  FROM places CROSS JOIN (VALUES (1, CAST(500 AS DOUBLE), CAST(5 AS DOUBLE)),
                                 (2, CAST(5000 AS DOUBLE), CAST(50 AS DOUBLE)),
                                 (3, CAST(25000 AS DOUBLE), CAST(250 AS DOUBLE))) AS l(lvl, hx, hy))"""
POLYS = """vertices AS (
  SELECT CAST(n_nationkey AS BIGINT) AS poly_id, CAST(seq AS BIGINT) AS seq,
         CAST(n_nationkey * 20000 AS DOUBLE) + dx AS x, CAST(n_nationkey * 96 AS DOUBLE) + dy AS y
  FROM nation CROSS JOIN (VALUES (0, CAST(-15000 AS DOUBLE), CAST(-120 AS DOUBLE)),
                                 (1, CAST(15000 AS DOUBLE), CAST(-120 AS DOUBLE)),
                                 (2, CAST(15000 AS DOUBLE), CAST(120 AS DOUBLE)),
                                 (3, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)),
                                 (4, CAST(-15000 AS DOUBLE), CAST(120 AS DOUBLE))) AS v(seq, dx, dy)),
edges AS (
  SELECT a.poly_id, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM vertices a JOIN vertices b ON a.poly_id = b.poly_id AND b.seq = (a.seq + 1) % 5),
envelopes AS (
  SELECT poly_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM vertices GROUP BY poly_id)"""
INSIDE = f"""{PTS}, {POLYS}, inside AS (
  SELECT e.poly_id, p.id FROM pts p JOIN edges e
    ON ((e.y1 > p.y) <> (e.y2 > p.y)) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
  GROUP BY e.poly_id, p.id HAVING count(*) % 2 = 1)"""


def grid_sql(nx: int, ny: int | None = None) -> str:
    """CTE ``cells``: pts with their equal-grid cell."""
    ny = ny or nx
    return f"""{EXT}, cells AS (
  SELECT p.*, CAST(least(floor((x - x0) / ((x1 - x0) / {nx})), {nx - 1})
              + least(floor((y - y0) / ((y1 - y0) / {ny})), {ny - 1}) * {nx} AS INTEGER) AS cell_id
  FROM pts p CROSS JOIN ext)"""
