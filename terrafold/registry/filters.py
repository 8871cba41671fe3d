"""Point, window, circle, distance and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.functions.values import rounded
from terrafold.operators import distance, joins, lookup, nearest
from terrafold.plans.ordering import number_rows
from terrafold.registry import core
from terrafold.registry.core import GEO, PTS, UNIT, WINDOWS, PLACES, query

WINDOW = (100000.0, 500.0, 150000.0, 900.0)
WINDOW_SQL = "x BETWEEN 100000 AND 150000 AND y BETWEEN 500 AND 900"
RANGE_SQL = f"WITH {PTS} SELECT id, x, y FROM pts WHERE {WINDOW_SQL}"


def r6(c):
    return F.round(c, 6)


@query("range_query", RANGE_SQL)
def range_query(spark, sf):
    return lookup.range_query(core.pts(spark, sf), WINDOW)


@query("range_query_clustered", RANGE_SQL)
def range_query_clustered(spark, sf):
    return core.layout(spark, sf).range_query(WINDOW)


@query("range_query_inverted", f"WITH {PTS} SELECT id, x, y FROM pts WHERE x BETWEEN 150000 AND 100000")
def range_query_inverted(spark, sf):
    return core.layout(spark, sf).range_query((150000.0, 900.0, 100000.0, 500.0))


RANGE_COUNT_SQL = f"WITH {PTS} SELECT count(*) AS n FROM pts WHERE x BETWEEN 50000 AND 400000 AND y BETWEEN 100 AND 2000"
BIG_WINDOW = (50000.0, 100.0, 400000.0, 2000.0)


@query("range_count", RANGE_COUNT_SQL)
def range_count(spark, sf):
    return lookup.range_count(core.pts(spark, sf), BIG_WINDOW)


@query("range_count_fastpath", RANGE_COUNT_SQL)
def range_count_fastpath(spark, sf):
    return core.layout(spark, sf).range_count(BIG_WINDOW)


PROBE = "probe AS (SELECT x AS qx, y AS qy FROM pts ORDER BY id DESC LIMIT 1)"


def _probe(spark, sf):
    """The place of the largest id: one row."""
    row = core.built(spark, sf, "probe", lambda: core.pts(spark, sf).agg(F.max_by(F.struct("x", "y"), "id").alias("p")).first())
    return row["p"]["x"], row["p"]["y"]


LOOKUP_SQL = f"WITH {PTS}, {PROBE} SELECT id, x, y FROM pts JOIN probe ON x = qx AND y = qy"


@query("point_lookup", LOOKUP_SQL)
def point_lookup(spark, sf):
    return lookup.point_lookup(core.pts(spark, sf), *_probe(spark, sf))


@query("point_lookup_clustered", LOOKUP_SQL)
def point_lookup_clustered(spark, sf):
    return core.layout(spark, sf).point_lookup(*_probe(spark, sf))


@query(
    "point_lookup_distinct",
    f"WITH {PTS}, {PROBE} SELECT id, x, y FROM pts JOIN probe ON x = qx AND y = qy ORDER BY id LIMIT 1",
)
def point_lookup_distinct(spark, sf):
    return lookup.point_lookup(core.pts(spark, sf), *_probe(spark, sf), distinct=True)


@query("point_exists", f"WITH {PTS}, {PROBE} SELECT count(*) > 0 AS found FROM pts JOIN probe ON x = qx AND y = qy")
def point_exists(spark, sf):
    return lookup.point_exists(core.pts(spark, sf), *_probe(spark, sf))


POINTS_EXIST_SQL = f"""WITH {PTS}, probes AS (
      SELECT id * 2 AS qid, x AS qx, y AS qy FROM pts
      UNION ALL SELECT id * 2 + 1, x + CAST(12345.678 AS DOUBLE), y - CAST(9876.543 AS DOUBLE) FROM pts)
    SELECT qid, EXISTS (SELECT 1 FROM pts WHERE x = qx AND y = qy) AS found FROM probes"""


def _probes(spark, sf):
    p = core.pts(spark, sf)
    here = p.select((F.col("id") * 2).alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    away = p.select(
        (F.col("id") * 2 + 1).alias("qid"), (F.col("x") + 12345.678).alias("qx"), (F.col("y") - 9876.543).alias("qy")
    )
    return here.unionByName(away)


@query("points_exist_indexed", POINTS_EXIST_SQL)
def points_exist_indexed(spark, sf):
    return lookup.indexed_points_exist(core.index(spark, sf), _probes(spark, sf)).select("qid", "found")


@query("points_exist", POINTS_EXIST_SQL)
def points_exist(spark, sf):
    return lookup.points_exist(core.pts(spark, sf), _probes(spark, sf)).select("qid", "found")


@query(
    "point_lookup_eps",
    f"""WITH {PTS}, {PROBE} SELECT id, x, y FROM pts CROSS JOIN probe
    WHERE x BETWEEN qx - CAST(0.5 AS DOUBLE) AND qx + CAST(0.5 AS DOUBLE)
      AND y BETWEEN qy - CAST(0.5 AS DOUBLE) AND qy + CAST(0.5 AS DOUBLE)""",
)
def point_lookup_eps(spark, sf):
    return lookup.point_lookup_eps(core.pts(spark, sf), *_probe(spark, sf), eps=0.5)


@query(
    "point_lookup_eps_strict",
    f"""WITH {PTS}, {PROBE} SELECT id, x, y FROM pts CROSS JOIN probe
    WHERE abs(x - qx) < CAST(1e-9 AS DOUBLE) AND abs(y - qy) < CAST(1e-9 AS DOUBLE)""",
)
def point_lookup_eps_strict(spark, sf):
    return lookup.point_lookup_eps(core.pts(spark, sf), *_probe(spark, sf), strict=True)


def _dist(source: str, qx: str, qy: str) -> str:
    return f"sqrt(({source}.x - {qx}) * ({source}.x - {qx}) + ({source}.y - {qy}) * ({source}.y - {qy}))"


KNN_SQL = f"""WITH {PTS}, d AS (SELECT id, x, y, {_dist('pts', '250000', '1200')} AS dist FROM pts)
SELECT id, x, y, round(dist, 6) AS dist FROM d ORDER BY d.dist, x, y, id LIMIT 10"""


@query("knn", KNN_SQL)
def knn(spark, sf):
    return nearest.knn(core.pts(spark, sf), 250000.0, 1200.0, 10).withColumn("dist", r6("dist"))


@query("knn_pruned", KNN_SQL)
def knn_pruned(spark, sf):
    return core.layout(spark, sf).knn(250000.0, 1200.0, 10).withColumn("dist", r6("dist"))


@query(
    "knn_normalized",
    f"""WITH {UNIT}, d AS (SELECT id, x, y, {_dist('unit', 'CAST(0.5 AS DOUBLE)', 'CAST(0.5 AS DOUBLE)')} AS dist FROM unit)
    SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(dist, 6) AS dist FROM d ORDER BY d.dist, d.x, d.y, id LIMIT 25""",
)
def knn_normalized(spark, sf):
    return nearest.knn(core.unit(spark, sf), 0.5, 0.5, 25).select("id", *[r6(c).alias(c) for c in ("x", "y", "dist")])


@query(
    "topk_refine",
    f"""WITH {PTS}, {WINDOWS}, d AS (
      SELECT w.qid, p.id, p.x, p.y, {_dist('p', '((w.min_x + w.max_x) / 2)', '((w.min_y + w.max_y) / 2)')} AS dist
      FROM pts p JOIN windows w ON p.x BETWEEN min_x AND max_x AND p.y BETWEEN min_y AND max_y)
    SELECT qid, id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, x, y, id) AS rank FROM d) WHERE rank <= 5""",
)
def topk_refine(spark, sf):
    w = core.windows(spark, sf)
    index = core.index(spark, sf)
    near = nearest.nearest_windows(index, w, 5)
    pairs = joins.window_join(index, near, rows=512, points=nearest.few_of_each_place(index, 5))
    mid = w.select("qid", ((F.col("min_x") + F.col("max_x")) / 2).alias("qx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("qy"))
    found = pairs.join(mid, "qid").withColumn("dist", g.distance("x", "y", "qx", "qy"))
    return nearest.topk_refine(found, 5).select("qid", "id", r6("dist").alias("dist"), "rank")


def _knn_join_sql(ctes: str, source: str, places: str, k: int) -> str:
    return f"""WITH {ctes}, d AS (
      SELECT q.qid, p.id, p.x, p.y, {_dist('p', 'q.qx', 'q.qy')} AS dist FROM {source} p CROSS JOIN {places} q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, x, y, id) AS rank FROM d)
    SELECT * FROM ranked WHERE rank <= {k}"""


UNIT_PLACES = f"""{PLACES}, unit_places AS (
  SELECT qid, qx / CAST(500000 AS DOUBLE) AS qx, qy / CAST(2405 AS DOUBLE) AS qy FROM places)"""
KNN_COLUMNS = "qid, id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank"


@query("knn_join", f"SELECT {KNN_COLUMNS} FROM ({_knn_join_sql(f'{PTS}, {PLACES}', 'pts', 'places', 10)})")
def knn_join(spark, sf):
    out = nearest.knn_join(core.index(spark, sf), core.places(spark, sf), 10)
    return out.select("qid", "id", r6("dist").alias("dist"), "rank")


@query("knn_join_nested", f"SELECT {KNN_COLUMNS} FROM ({_knn_join_sql(f'{PTS}, {PLACES}', 'pts', 'places', 10)})")
def knn_join_nested(spark, sf):
    """The same join under a nested grid."""
    out = nearest.knn_join(core.nested_index(spark, sf), core.places(spark, sf), 10)
    return out.select("qid", "id", r6("dist").alias("dist"), "rank")


@query(
    "knn_join_normalized",
    f"SELECT {KNN_COLUMNS} FROM ({_knn_join_sql(f'{UNIT}, {UNIT_PLACES}', 'unit', 'unit_places', 10)})",
)
def knn_join_normalized(spark, sf):
    out = nearest.knn_join(core.unit_index(spark, sf), core.unit_places(spark, sf), 10)
    return out.select("qid", "id", r6("dist").alias("dist"), "rank")


@query(
    "knn_sweep",
    f"""SELECT qid, CAST(k AS INTEGER) AS k, count(*) AS n, round(max(dist), 6) AS kth_dist
    FROM ({_knn_join_sql(f'{UNIT}, {UNIT_PLACES}', 'unit', 'unit_places', 100)}) JOIN (VALUES (1), (10), (50), (100)) AS s(k)
      ON rank <= k GROUP BY qid, k""",
)
def knn_sweep(spark, sf):
    out = nearest.knn_sweep(core.unit_index(spark, sf), core.unit_places(spark, sf), [1, 10, 50, 100])
    return out.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.max("dist")).alias("kth_dist"))


@query(
    "circle_query",
    f"""WITH {UNIT} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM unit
    WHERE (x - CAST(0.5 AS DOUBLE)) * (x - CAST(0.5 AS DOUBLE)) + (y - CAST(0.5 AS DOUBLE)) * (y - CAST(0.5 AS DOUBLE))
      <= CAST(0.05 AS DOUBLE) * CAST(0.05 AS DOUBLE)""",
)
def circle_query(spark, sf):
    out = lookup.circle_query(core.unit(spark, sf), 0.5, 0.5, 0.05)
    return out.select("id", r6("x").alias("x"), r6("y").alias("y"))


CIRCLE_SQL = "(x - 250000) * (x - 250000) + (y - 1200) * (y - 1200) <= CAST(1000 AS DOUBLE) * 1000"


@query("circle_query_clustered", f"WITH {PTS} SELECT id, x, y FROM pts WHERE {CIRCLE_SQL}")
def circle_query_clustered(spark, sf):
    return core.layout(spark, sf).circle_query(250000.0, 1200.0, 1000.0)


@query("circle_count", f"WITH {PTS} SELECT count(*) AS n FROM pts WHERE {CIRCLE_SQL}")
def circle_count(spark, sf):
    return lookup.circle_count(core.pts(spark, sf), 250000.0, 1200.0, 1000.0)


def haversine_sql(lat: str, lon: str) -> str:
    return f"""2 * CAST(6378137 AS DOUBLE) * asin(least(1.0, sqrt(
      pow(sin((radians({lat}) - radians(lat)) / 2), 2)
      + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2))))"""


@query(
    "distance_query",
    f"""WITH {GEO}, d AS (SELECT *, {haversine_sql('40.75', '-73.98')} AS m FROM geo)
    SELECT id, lat, lon, round(m, 3) AS dist_m FROM d WHERE m <= 20000""",
)
def distance_query(spark, sf):
    out = distance.distance_query(core.geo(spark, sf), 40.75, -73.98, 20000.0)
    return out.withColumn("dist_m", F.round("dist_m", 3))


@query(
    "distance_query_antimeridian",
    f"""WITH {GEO}, shifted AS (
      SELECT id, lat, CASE WHEN lon + 253.5 > 180 THEN lon + 253.5 - 360 ELSE lon + 253.5 END AS lon FROM geo),
    d AS (SELECT *, {haversine_sql('41.0', '179.9')} AS m FROM shifted)
    SELECT id, lat, round(lon, 9) AS lon, round(m, 3) AS dist_m FROM d WHERE m <= 60000""",
)
def distance_query_antimeridian(spark, sf):
    east = F.col("lon") + 253.5  # the same points moved so that they straddle +-180 degrees
    moved = core.geo(spark, sf).withColumn("lon", F.when(east > 180, east - 360).otherwise(east))
    out = distance.distance_query(moved, 41.0, 179.9, 60000.0)
    return out.select("id", "lat", F.round("lon", 9).alias("lon"), F.round("dist_m", 3).alias("dist_m"))


@query(
    "distance_query_clustered",
    f"""WITH {GEO}, d AS (SELECT *, {haversine_sql('40.75', '-73.98')} AS m FROM geo)
    SELECT id, lat, lon, round(m, 3) AS dist_m FROM d WHERE m <= 20000""",
)
def distance_query_clustered(spark, sf):
    out = core.geo_layout(spark, sf).distance_query(40.75, -73.98, 20000.0)
    return out.select("id", F.col("y").alias("lat"), F.col("x").alias("lon"), F.round("dist_m", 3).alias("dist_m"))


SPOTS = f"""{GEO}, spots AS (
  SELECT s_suppkey AS qid, CAST(40 AS DOUBLE) + (s_suppkey % 21) / CAST(10 AS DOUBLE) AS qlat,
         CAST(-75 AS DOUBLE) + (s_suppkey % 31) / CAST(10 AS DOUBLE) AS qlon,
         CAST(500 * (1 + s_suppkey % 40) AS DOUBLE) AS metres FROM supplier),
near AS (SELECT * FROM (SELECT qid, id, metres, {haversine_sql('qlat', 'qlon')} AS m FROM spots CROSS JOIN geo) WHERE m <= metres)"""


def _spots(spark, sf):
    k = F.col("s_suppkey")
    return core.table(spark, sf, "supplier").select(
        k.alias("qid"), (F.lit(40.0) + (k % 21) / F.lit(10.0)).alias("lat"), (F.lit(-75.0) + (k % 31) / F.lit(10.0)).alias("lon"),
        (F.lit(500) * (1 + k % 40)).cast("double").alias("metres"),
    )


@query("distance_join", f"WITH {SPOTS} SELECT qid, id, round(m, 3) AS dist_m FROM near")
def distance_join(spark, sf):
    out = distance.distance_join(core.geo_index(spark, sf), _spots(spark, sf))
    return out.select("qid", "id", rounded(F.col("dist_m"), 3).alias("dist_m"))


@query("distance_counts", f"WITH {SPOTS} SELECT s.qid, count(n.id) AS n FROM spots s LEFT JOIN near n ON s.qid = n.qid GROUP BY s.qid")
def distance_counts(spark, sf):
    return distance.distance_counts(core.geo_index(spark, sf), _spots(spark, sf))


@query(
    "row_numbers",
    f"WITH {PTS} SELECT id, row_number() OVER (ORDER BY y, x, id) - 1 AS row_no FROM pts",
)
def row_numbers(spark, sf):
    return number_rows(core.pts(spark, sf), ["y", "x", "id"], n=core.ext(spark, sf).n).select("id", "row_no")


@query("sort_by_y", f"WITH {PTS} SELECT id, x, y FROM pts ORDER BY y, x, id")
def sort_by_y(spark, sf):
    return lookup.sort_by_y(core.pts(spark, sf))


# ---------------------------------------------------------------- the same queries over every layout

for _method in core.LAYOUTS:

    @query(f"range_query_{_method}", RANGE_SQL)
    def range_query_layout(spark, sf, method=_method):
        return core.layout(spark, sf, method).range_query(WINDOW)

    @query(f"range_count_{_method}", RANGE_COUNT_SQL)
    def range_count_layout(spark, sf, method=_method):
        return core.layout(spark, sf, method).range_count(BIG_WINDOW)

    @query(f"point_lookup_{_method}", LOOKUP_SQL)
    def point_lookup_layout(spark, sf, method=_method):
        return core.layout(spark, sf, method).point_lookup(*_probe(spark, sf))

    @query(f"knn_{_method}", KNN_SQL)
    def knn_layout(spark, sf, method=_method):
        return core.layout(spark, sf, method).knn(250000.0, 1200.0, 10).withColumn("dist", r6("dist"))
