"""Batch joins with windows and polygons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrafold.operators import joins, sampling
from terrafold.plans.cover import ShapeCover
from terrafold.plans.ordering import number_rows
from terrafold.plans.session import scratch_path, written
from terrafold.registry import core
from terrafold.registry.core import EXT, INSIDE, PLACES, POLYS, PTS, WINDOWS, query
from terrafold.sources import readers
from terrafold.streaming.filters import read_point_stream, run_to_files

IN_WINDOW = "p.x BETWEEN w.min_x AND w.max_x AND p.y BETWEEN w.min_y AND w.max_y"


@query("window_join", f"WITH {PTS}, {WINDOWS} SELECT w.qid, p.id FROM windows w JOIN pts p ON {IN_WINDOW}")
def window_join(spark, sf):
    return joins.window_join(core.index(spark, sf), core.windows(spark, sf)).select("qid", "id")


@query(
    "window_counts",
    f"""WITH {PTS}, {WINDOWS}
    SELECT w.qid, w.lvl, count(p.id) AS n FROM windows w LEFT JOIN pts p ON {IN_WINDOW} GROUP BY w.qid, w.lvl""",
)
def window_counts(spark, sf):
    return joins.window_counts(core.index(spark, sf), core.windows(spark, sf)).select("qid", "lvl", "n")


@query(
    "window_counts_nested",
    f"""WITH {PTS}, {WINDOWS}
    SELECT w.qid, w.lvl, count(p.id) AS n FROM windows w LEFT JOIN pts p ON {IN_WINDOW} GROUP BY w.qid, w.lvl""",
)
def window_counts_nested(spark, sf):
    return joins.window_counts(core.nested_index(spark, sf), core.windows(spark, sf)).select("qid", "lvl", "n")


@query(
    "window_selectivity_sweep",
    f"""WITH {EXT}, {PLACES}, levels AS (
      SELECT CAST(lvl AS INTEGER) AS lvl, sqrt(s * (x1 - x0) * (y1 - y0)) / 2 AS h FROM ext CROSS JOIN
        (VALUES (0, CAST(1e-7 AS DOUBLE)), (1, CAST(1e-6 AS DOUBLE)), (2, CAST(1e-5 AS DOUBLE)),
                (3, CAST(1e-4 AS DOUBLE)), (4, CAST(1e-3 AS DOUBLE))) AS v(lvl, s)),
    w AS (SELECT qid, lvl, qx - h AS min_x, qy - h AS min_y, qx + h AS max_x, qy + h AS max_y FROM places CROSS JOIN levels),
    c AS (SELECT w.qid, w.lvl, count(p.id) AS n FROM w LEFT JOIN pts p ON {IN_WINDOW} GROUP BY w.qid, w.lvl)
    SELECT lvl, count(*) AS windows, CAST(sum(c.n) AS BIGINT) AS n, round(sum(c.n) / CAST(max(ext.n) AS DOUBLE) / count(*), 9) AS selectivity
    FROM c CROSS JOIN ext GROUP BY lvl""",
)
def window_selectivity_sweep(spark, sf):
    e = core.ext(spark, sf)
    sweep = sampling.selectivity_windows(core.places(spark, sf), e.area)
    sweep = sweep.withColumn("wid", F.col("qid") * 10 + F.col("lvl"))
    counted = joins.window_selectivity(core.index(spark, sf), sweep, "wid")
    return counted.groupBy("lvl").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("n").alias("n"),
        F.round(F.sum("n") / F.lit(float(e.n)) / F.count(F.lit(1)), 9).alias("selectivity"),
    )


IN_ENVELOPE = "p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y"


@query("envelope_join", f"WITH {PTS}, {POLYS} SELECT poly_id, p.id FROM envelopes JOIN pts p ON {IN_ENVELOPE}")
def envelope_join(spark, sf):
    return joins.envelope_join(core.index(spark, sf), core.polys(spark, sf)).select("poly_id", "id")


@query(
    "envelope_counts",
    f"WITH {PTS}, {POLYS} SELECT poly_id, count(p.id) AS n FROM envelopes LEFT JOIN pts p ON {IN_ENVELOPE} GROUP BY poly_id",
)
def envelope_counts(spark, sf):
    return joins.envelope_counts(core.index(spark, sf), core.polys(spark, sf))


@query(
    "envelope_points_nested",
    f"""WITH {PTS}, {POLYS}
    SELECT poly_id, CAST(floor(p.id / 10000) AS BIGINT) AS part, count(*) AS n,
           string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) AS ids
    FROM envelopes JOIN pts p ON {IN_ENVELOPE} GROUP BY poly_id, floor(p.id / 10000)""",
)
def envelope_points_nested(spark, sf):
    pairs = joins.envelope_join(core.index(spark, sf), core.polys(spark, sf))
    nested = joins.nested_points(pairs)
    return nested.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("polygon_join", f"WITH {INSIDE} SELECT poly_id, id FROM inside")
def polygon_join(spark, sf):
    return joins.polygon_join(core.index(spark, sf), core.polys(spark, sf)).select("poly_id", "id")


@query("polygon_join_by_edges", f"WITH {INSIDE} SELECT poly_id, id FROM inside")
def polygon_join_by_edges(spark, sf):
    edges = readers.edges_from_vertices(core.vertices(spark, sf))
    return joins.polygon_join_by_edges(core.index(spark, sf), edges).select("poly_id", "id")


STAR = f"""{PTS}, star AS (
  SELECT seq, 250000 + (20000 + x / 2.5) * cos(2 * pi() * seq / n) AS x, 1200 + (100 + x / 500) * sin(2 * pi() * seq / n) AS y
  FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS seq, count(*) OVER () AS n, x FROM pts)),
rim AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM star a JOIN star b ON b.seq = (a.seq + 1) % (SELECT count(*) FROM star))"""


@query(
    "polygon_join_many_edges",
    f"""WITH {STAR}, cut AS (SELECT floor(y / 10) AS s, x, y, id FROM pts),
    edge AS (SELECT *, unnest(range(CAST(floor(least(y1, y2) / 10) AS BIGINT), CAST(floor(greatest(y1, y2) / 10) AS BIGINT) + 1)) AS s FROM rim)
    SELECT CAST(1 AS BIGINT) AS poly_id, p.id FROM cut p JOIN edge e ON e.s = p.s
      AND ((e.y1 > p.y) <> (e.y2 > p.y)) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
    GROUP BY p.id HAVING count(*) % 2 = 1""",
)
def polygon_join_many_edges(spark, sf):
    """One polygon with a vertex per order."""
    p, n = core.pts(spark, sf), core.ext(spark, sf).n
    turn = F.lit(2 * math.pi) * F.col("seq") / F.lit(n)
    ring = number_rows(p, ["id"], "seq", n=n).select(
        F.lit(1).cast("bigint").alias("poly_id"), "seq",
        (250000 + (20000 + F.col("x") / 2.5) * F.cos(turn)).alias("x"), (1200 + (100 + F.col("x") / 500) * F.sin(turn)).alias("y"),
    )
    edges = readers.edges_from_vertices(written(ring, "star"))
    return joins.polygon_join_by_edges(core.index(spark, sf), edges).select("poly_id", "id")


def _order_stream(spark, sf):
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    stream = read_point_stream(spark, sf, core.table(spark, sf, "orders").schema, "orders.parquet")
    return stream.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), days.alias("y"))


@query("stream_polygon_join", f"WITH {INSIDE} SELECT poly_id, id FROM inside")
def stream_polygon_join(spark, sf):
    """A stream of orders against a stored cover of the polygons."""
    cover = core.built(spark, sf, "polygon_cover", lambda: ShapeCover.of_polygons(core.polys(spark, sf)))
    out = run_to_files(_order_stream(spark, sf), scratch_path(spark, "stream-out"), cover.join)
    return out.select("poly_id", "id")


@query("stream_envelope_join", f"WITH {PTS}, {POLYS} SELECT poly_id, p.id FROM envelopes JOIN pts p ON {IN_ENVELOPE}")
def stream_envelope_join(spark, sf):
    cover = core.built(
        spark, sf, "envelope_cover", lambda: ShapeCover.of_windows(joins.polygon_envelopes(core.polys(spark, sf)), "poly_id")
    )
    out = run_to_files(_order_stream(spark, sf), scratch_path(spark, "stream-out"), cover.join)
    return out.select("poly_id", "id")


@query("polygon_join_by_cover", f"WITH {INSIDE} SELECT poly_id, id FROM inside")
def polygon_join_by_cover(spark, sf):
    """The same cover against the table, which then needs no index."""
    cover = core.built(spark, sf, "polygon_cover", lambda: ShapeCover.of_polygons(core.polys(spark, sf)))
    return cover.join(core.pts(spark, sf)).select("poly_id", "id")


@query(
    "polygon_counts",
    f"""WITH {INSIDE} SELECT e.poly_id, count(i.id) AS n FROM envelopes e LEFT JOIN inside i ON e.poly_id = i.poly_id
    GROUP BY e.poly_id""",
)
def polygon_counts(spark, sf):
    return joins.polygon_counts(core.index(spark, sf), core.polys(spark, sf))


@query("points_in_any_polygon", f"WITH {INSIDE} SELECT id, x, y FROM pts WHERE id IN (SELECT id FROM inside)")
def points_in_any_polygon(spark, sf):
    return joins.points_in_any_polygon(core.index(spark, sf), core.polys(spark, sf))


@query("points_in_no_polygon", f"WITH {INSIDE} SELECT id, x, y FROM pts WHERE id NOT IN (SELECT id FROM inside)")
def points_in_no_polygon(spark, sf):
    return joins.points_in_no_polygon(core.index(spark, sf), core.polys(spark, sf))
