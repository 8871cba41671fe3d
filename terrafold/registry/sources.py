"""Readers and sinks, fed with files that Spark writes from the tables; and the stream form of a filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import cells, diagnostics, lookup
from terrafold.plans.session import scratch_path
from terrafold.registry import core
from terrafold.registry.core import DIRTY, POLYS, PTS, WINDOWS, query
from terrafold.registry.filters import RANGE_SQL, WINDOW
from terrafold.sources import readers, sinks
from terrafold.sources.layout import ClusteredPoints
from terrafold.streaming.filters import read_point_stream, run_to_files


def _files(spark, sf, name, write):
    """Write once per session, return the path."""

    def make():
        path = scratch_path(spark, name)
        write(path)
        return path

    return core.built(spark, sf, f"files:{name}", make)


@query("read_points_csv", f"WITH {PTS} SELECT x, y FROM pts")
def read_points_csv(spark, sf):
    path = _files(spark, sf, "points-csv", lambda p: core.pts(spark, sf).write.csv(p))
    return readers.read_points_csv(spark, path, offset=1).select("x", "y")


@query("read_points_csv_header", f"WITH {PTS} SELECT x, y FROM pts")
def read_points_csv_header(spark, sf):
    path = _files(spark, sf, "points-csv-header", lambda p: core.pts(spark, sf).select("x", "y").write.option("header", True).csv(p))
    return readers.read_points_csv(spark, path, header=True).select("x", "y")


@query(
    "read_points_json",
    f"WITH {DIRTY} SELECT x, y FROM dirty",
)
def read_points_json(spark, sf):
    wkt = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    lines = core.dirty(spark, sf).select(F.to_json(F.struct("id", F.coalesce(wkt, F.lit("unknown")).alias("g"))))
    path = _files(spark, sf, "points-json", lines.write.text)
    return readers.read_points_json(spark, path).select("x", "y")


@query("read_windows_csv", f"WITH {WINDOWS} SELECT min_x, min_y, max_x, max_y FROM windows")
def read_windows_csv(spark, sf):
    named = core.windows(spark, sf).select(
        *[F.col(a).alias(b) for a, b in zip(("min_x", "min_y", "max_x", "max_y"), readers.WINDOW_COLUMNS)]
    )
    path = _files(spark, sf, "windows-csv", lambda p: named.write.option("header", True).csv(p))
    return readers.read_windows_csv(spark, path).drop("qid")


@query(
    "read_polygons_csv",
    f"""WITH {POLYS} SELECT poly_id, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR), ','
      ORDER BY seq) AS ring FROM vertices GROUP BY poly_id""",
)
def read_polygons_csv(spark, sf):
    named = core.vertices(spark, sf).withColumnRenamed("poly_id", "polygon_id")
    path = _files(spark, sf, "polygons-csv", lambda p: named.write.option("header", True).csv(p))
    text = F.transform("ring", lambda v: F.concat_ws(" ", v["x"].cast("bigint"), v["y"].cast("bigint")))
    return readers.read_polygons_csv(spark, path).select("poly_id", F.array_join(text, ",").alias("ring"))


@query(
    "edges_from_vertices",
    f"WITH {POLYS} SELECT poly_id, seq, x1, y1, x2, y2 FROM edges",
)
def edges_from_vertices(spark, sf):
    return readers.edges_from_vertices(core.vertices(spark, sf))


@query(
    "polygon_runs",
    f"""WITH {PTS}, v AS (SELECT id // 5 AS poly_id, id % 5 AS seq, x, y FROM pts WHERE id <> (SELECT max(id) FROM pts))
    SELECT poly_id, seq, x, y FROM v WHERE poly_id IN (SELECT poly_id FROM v GROUP BY poly_id HAVING count(*) = 5)""",
)
def polygon_runs(spark, sf):
    p = core.pts(spark, sf).withColumnRenamed("id", "row_no")
    last = p.agg(F.max("row_no")).scalar()
    return readers.vertex_runs(p.filter(F.col("row_no") != last))


@query(
    "polygon_runs_incomplete",
    f"""WITH {PTS}, v AS (SELECT id // 5 AS poly_id FROM pts WHERE id % 7 <> 0)
    SELECT poly_id, count(*) AS vertices FROM v GROUP BY poly_id HAVING count(*) <> 5""",
)
def polygon_runs_incomplete(spark, sf):
    p = core.pts(spark, sf).withColumnRenamed("id", "row_no")
    return readers.incomplete_runs(p.filter(F.col("row_no") % 7 != 0))


@query(
    "merge_files",
    f"""WITH {PTS}, {WINDOWS} SELECT CAST('points' AS VARCHAR) AS kind, count(*) AS n, count(x) AS with_x FROM pts
    UNION ALL SELECT 'windows', count(*), 0 FROM windows""",
)
def merge_files(spark, sf):
    points = _files(spark, sf, "points-csv-header", lambda p: core.pts(spark, sf).select("x", "y").write.option("header", True).csv(p))
    named = core.windows(spark, sf)
    boxes = _files(spark, sf, "windows-merge", lambda p: named.write.option("header", True).csv(p))
    merged = readers.read_many(spark, [f"{points}/*.csv", f"{boxes}/*.csv"])
    kind = F.when(F.col("source").contains("points-csv-header"), "points").otherwise("windows")
    return merged.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("with_x"))


@query(
    "append_report",
    f"""WITH {PTS} SELECT v.label, count(*) AS n_before, CAST(0 AS BIGINT) AS n_lost FROM pts
    CROSS JOIN (VALUES ('first'), ('second')) v(label) GROUP BY v.label""",
)
def append_report(spark, sf):
    p = core.pts(spark, sf)

    def write(path):
        assigned = cells.grid_cells(p, 20, ext=core.ext(spark, sf))
        for label in ("first", "second"):
            sinks.append_report(diagnostics.report(p, assigned, "grid", 400, label), path)

    path = scratch_path(spark, "report")
    write(path)
    return spark.read.json(path).select("label", "n_before", "n_lost")


@query(
    "read_build_log",
    """SELECT user_id AS run_no, upper(substr(event_type, 1, 1)) || 'P' AS variant, CAST(count(*) AS BIGINT) AS ms
    FROM events WHERE user_id % 10 <> 3 GROUP BY 1, 2""",
)
def read_build_log(spark, sf):
    variant = F.concat(F.upper(F.substring("event_type", 1, 1)), F.lit("P"))
    timed = core.table(spark, sf, "events").groupBy("user_id", variant.alias("v")).agg(F.count(F.lit(1)).alias("ms"))
    line = F.concat(F.lit("build "), F.col("v"), F.lit("IndexBuild:\nIndex build time : "), F.col("ms").cast("string"))
    # one row per variant and run: bounded by the number of variants
    runs = timed.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    failed = F.when(F.col("user_id") % 10 == 3, "FAILED ").otherwise("")
    text = runs.select(F.concat(F.lit("--- Run "), F.col("user_id").cast("string"), F.lit(" "), failed, F.lit("---\n"), "body"))
    return readers.read_build_log(spark, _files(spark, sf, "build-log", text.write.text))


@query("layout_roundtrip", f"WITH {PTS} SELECT id, x, y FROM pts")
def layout_roundtrip(spark, sf):
    return core.layout(spark, sf).points.select("id", "x", "y")


@query("range_query_z_order", RANGE_SQL)
def range_query_z_order(spark, sf):
    """The window over a layout in Z-order."""

    def make():
        return ClusteredPoints.write(cells.kd_tree_cells(core.pts(spark, sf)), scratch_path(spark, "layout-z"), order="z")

    return core.built(spark, sf, "layout-z", make).range_query(WINDOW)


@query("stream_range_query", RANGE_SQL)
def stream_range_query(spark, sf):
    """The window filter as a stream over the orders file."""
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    stream = read_point_stream(spark, sf, core.table(spark, sf, "orders").schema, "orders.parquet")
    points = stream.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), days.alias("y"))
    return run_to_files(points, scratch_path(spark, "stream-out"), lambda df: lookup.range_query(df, WINDOW))
