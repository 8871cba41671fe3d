"""Readers for point, polygon and window files and for build logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.plans.ordering import number_rows, with_neighbours

# Formats of the inputs.
WKT_POINT = r"^\s*POINT\s*\(\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*\)\s*$"
WKT_FIELD = "$.g"
WINDOW_COLUMNS = ("fromX", "fromY", "toX", "toY")
RUN_VERTICES = 5
LOG_RUN = r"(?s)--- Run (\d+)(.*?)(?=--- Run \d|\z)"
LOG_BUILD = r"build (\w+)IndexBuild:\r?\nIndex build time : (\d+)"
LOG_BAD_RUN = r"SKIPPED|FAILED"


def _number(value: Column, strict: bool) -> Column:
    number = value.try_cast("double")
    return F.coalesce(number, F.raise_error(F.lit("a row without a number")).cast("double")) if strict else number


def read_points_csv(
    spark: SparkSession, path: str | list[str], offset: int = 0, header: bool = False, mode: str = "PERMISSIVE",
    with_id: bool = True,
) -> DataFrame:
    """Points from columns ``offset`` and ``offset + 1`` of CSV files.

    PERMISSIVE turns bad numbers into nulls for the cleaning step, FAILFAST stops the job. ``id`` follows the
    file splits; pass ``with_id=False`` where rows need none.
    """
    raw = spark.read.option("header", header).csv(path)
    strict = mode.upper() == "FAILFAST"
    x, y = (F.col(f"`{raw.columns[i]}`") for i in (offset, offset + 1))
    picked = [_number(x, strict).alias("x"), _number(y, strict).alias("y")]
    return raw.select(*([F.monotonically_increasing_id().alias("id")] if with_id else []), *picked)


def parse_wkt_points(lines: DataFrame, value: str = "value") -> DataFrame:
    """x (longitude) and y (latitude) from JSON lines with a WKT point; lines without one give nulls."""
    wkt = F.get_json_object(value, WKT_FIELD)
    return lines.select(
        F.regexp_extract(wkt, WKT_POINT, 1).try_cast("double").alias("x"),
        F.regexp_extract(wkt, WKT_POINT, 2).try_cast("double").alias("y"),
    )


def read_points_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_wkt_points(spark.read.text(path)).withColumn("id", F.monotonically_increasing_id()).select("id", "x", "y")


def read_windows_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Query windows with header fromX,fromY,toX,toY."""
    schema = ", ".join(f"{name} double" for name in WINDOW_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    names = ("min_x", "min_y", "max_x", "max_y")
    return raw.select(
        F.monotonically_increasing_id().alias("qid"), *[F.col(c).alias(n) for c, n in zip(WINDOW_COLUMNS, names)]
    )


def read_many(
    spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame] | None = None
) -> DataFrame:
    """Union of several files or globs by column name, with the source file of every row."""

    def one(path: str) -> DataFrame:
        if read is not None:
            return read(spark, path).withColumn("source", F.lit(path))
        return spark.read.option("header", True).csv(path).withColumn("source", F.col("_metadata.file_path"))

    out = one(paths[0])
    for path in paths[1:]:
        out = out.unionByName(one(path), allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- polygons


def rings_from_vertices(vertices: DataFrame, key: str = "poly_id") -> DataFrame:
    """One row per polygon: ``ring`` in ``seq`` order. The ring is one value; for huge polygons use edges."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    ring = F.transform(ordered, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return vertices.groupBy(key).agg(ring.alias("ring"))


def edges_from_vertices(vertices: DataFrame, key: str = "poly_id", chunk: int = 100_000) -> DataFrame:
    """Edge table (poly_id, seq, x1, y1, x2, y2) with closing edges, without gathering any polygon in one row."""
    numbered = number_rows(vertices, ["seq"], "no", by=[key])
    staged = with_neighbours(numbered, "no", chunk, [key])
    w = Window.partitionBy(key, "__chunk").orderBy("no")
    first = vertices.groupBy(key).agg(F.min_by(F.struct("x", "y"), "seq").alias("first"))
    linked = staged.withColumn("next", F.lead(F.struct("x", "y")).over(w)).filter("__own").join(first, key)
    to = F.coalesce("next", "first")
    edges = linked.select(
        key, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), to["x"].alias("x2"), to["y"].alias("y2")
    )
    return edges.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def read_vertices_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Vertices with header polygon_id,seq,x,y. The order is explicit because shuffles do not keep file order."""
    raw = spark.read.schema("polygon_id bigint, seq bigint, x double, y double").option("header", True).csv(path)
    return raw.withColumnRenamed("polygon_id", "poly_id")


def read_polygons_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return rings_from_vertices(read_vertices_csv(spark, path))


def vertex_runs(rows: DataFrame, run: int = RUN_VERTICES) -> DataFrame:
    """Vertices of polygons given as runs of rows: row_no 0..4 is polygon 0, 5..9 polygon 1, and so on.

    Incomplete runs are dropped; ``incomplete_runs`` reports them.
    """
    split = _runs(rows, run)
    whole = split.groupBy("poly_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == run).drop("c")
    return split.join(whole, "poly_id", "left_semi")


def incomplete_runs(rows: DataFrame, run: int = RUN_VERTICES) -> DataFrame:
    return _runs(rows, run).groupBy("poly_id").agg(F.count(F.lit(1)).alias("vertices")).filter(F.col("vertices") != run)


def _runs(rows: DataFrame, run: int) -> DataFrame:
    return rows.select(
        F.floor(F.col("row_no") / run).cast("bigint").alias("poly_id"), (F.col("row_no") % run).alias("seq"), "x", "y"
    )


# ---------------------------------------------------------------- build logs


def read_build_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(run_no, variant, ms) from build logs; runs marked skipped or failed are left out."""
    logs = spark.read.text(path, wholetext=True)
    heads = F.regexp_extract_all("value", F.lit(LOG_RUN), F.lit(1))
    bodies = F.regexp_extract_all("value", F.lit(LOG_RUN), F.lit(2))
    runs = logs.select(F.explode(F.arrays_zip(heads.alias("no"), bodies.alias("body"))).alias("run")).select(
        F.col("run.no").cast("bigint").alias("run_no"), F.col("run.body").alias("body")
    )
    good = runs.filter(~F.col("body").rlike(LOG_BAD_RUN))
    names = F.regexp_extract_all("body", F.lit(LOG_BUILD), F.lit(1))
    times = F.regexp_extract_all("body", F.lit(LOG_BUILD), F.lit(2))
    return good.select("run_no", F.explode(F.arrays_zip(names.alias("v"), times.alias("ms"))).alias("b")).select(
        "run_no", F.col("b.v").alias("variant"), F.col("b.ms").cast("bigint").alias("ms")
    )
