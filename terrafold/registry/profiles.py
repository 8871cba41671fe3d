"""Cleaning, profiling, sampling and run-time summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import diagnostics, joins, prepare, profile, sampling
from terrafold.operators.sketches import RANK_ERROR, SketchIndex
from terrafold.plans.extent import extent
from terrafold.plans.ordering import exact_quantiles
from terrafold.plans.pyramid import BOX
from terrafold.plans.session import written
from terrafold.registry import core
from terrafold.registry.core import DIRTY, DIRTY_BOX, EXT, PTS, TIES, UNIT, WINDOWS, query


def r6(c):
    return F.round(c, 6)


IN_BOX = "x BETWEEN 0 AND 500000 AND y BETWEEN 0 AND 2500"


@query("drop_missing", f"WITH {DIRTY} SELECT id, x, y FROM dirty WHERE x IS NOT NULL AND y IS NOT NULL")
def drop_missing(spark, sf):
    return prepare.drop_missing(core.dirty(spark, sf))


@query("drop_zero_island", f"WITH {DIRTY} SELECT id, x, y FROM dirty WHERE NOT (x = 0 AND y = 0)")
def drop_zero_island(spark, sf):
    return prepare.drop_zero_island(core.dirty(spark, sf))


@query("keep_in_box", f"WITH {DIRTY} SELECT id, x, y FROM dirty WHERE {IN_BOX}")
def keep_in_box(spark, sf):
    return prepare.keep_in_box(core.dirty(spark, sf), DIRTY_BOX)


@query(
    "clean_points",
    f"WITH {DIRTY} SELECT id, x, y FROM dirty WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0) AND {IN_BOX}",
)
def clean_points(spark, sf):
    return prepare.clean_points(core.dirty(spark, sf), DIRTY_BOX)


@query(
    "validity_report",
    f"""WITH {DIRTY}, why AS (
      SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN x = 0 AND y = 0 THEN 'zero_island'
                  WHEN NOT ({IN_BOX}) THEN 'out_of_box' ELSE 'valid' END AS why FROM dirty),
    c AS (SELECT count(*) AS n_raw, count(*) FILTER (why = 'valid') AS n_valid,
      count(*) FILTER (why = 'missing') AS n_missing, count(*) FILTER (why = 'zero_island') AS n_zero_island,
      count(*) FILTER (why = 'out_of_box') AS n_out_of_box FROM why)
    SELECT *, n_raw - n_valid AS n_dropped, round((n_raw - n_valid) / CAST(n_raw AS DOUBLE), 6) AS drop_rate FROM c""",
)
def validity_report(spark, sf):
    return prepare.validity_report(core.dirty(spark, sf), DIRTY_BOX).withColumn("drop_rate", r6("drop_rate"))


@query("minmax_normalize", f"WITH {UNIT} SELECT id, round(x, 9) AS x, round(y, 9) AS y FROM unit")
def minmax_normalize(spark, sf):
    return core.unit(spark, sf).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("extent", f"WITH {EXT} SELECT n, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y FROM ext")
def extent_(spark, sf):
    return extent(core.pts(spark, sf))


@query(
    "extent_empty",
    f"WITH {PTS} SELECT count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM pts WHERE x < 0",
)
def extent_empty(spark, sf):
    return extent(core.pts(spark, sf).filter("x < 0"))


STATS = """count({a}) AS n, round(avg({a}), 6) AS mean, round(stddev_samp({a}), 6) AS std, min({a}) AS min, max({a}) AS max"""


@query(
    "axis_stats",
    f"""WITH {PTS} SELECT 'x' AS axis, {STATS.format(a='x')} FROM pts
    UNION ALL SELECT 'y' AS axis, {STATS.format(a='y')} FROM pts""",
)
def axis_stats(spark, sf):
    out = profile.axis_statistics(core.pts(spark, sf))
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "axis_stats_vectors",
    f"""WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
    SELECT 'x' AS axis, {STATS.format(a='x')} FROM p UNION ALL SELECT 'y' AS axis, {STATS.format(a='y')} FROM p""",
)
def axis_stats_vectors(spark, sf):
    out = profile.axis_statistics(core.emb(spark, sf))
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


def _quantile_sql(axis: str) -> str:
    return f"""SELECT '{axis}' AS axis, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(q1 - 1.5 * (q3 - q1), 6) AS low_fence, round(q3 + 1.5 * (q3 - q1), 6) AS high_fence,
      count(*) FILTER ({axis} < q1 - 1.5 * (q3 - q1) OR {axis} > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM pts CROSS JOIN (SELECT quantile_cont({axis}, 0.25) AS q1, quantile_cont({axis}, 0.5) AS median,
      quantile_cont({axis}, 0.75) AS q3 FROM pts) GROUP BY q1, median, q3"""


@query("quantiles", f"WITH {PTS} {_quantile_sql('x')} UNION ALL {_quantile_sql('y')}")
def quantiles(spark, sf):
    p = core.pts(spark, sf)
    names = ("q1", "median", "q3", "low_fence", "high_fence")
    rows = [
        profile.quantile_profile(p, a, core.ext(spark, sf).n).select(F.lit(a).alias("axis"), *[r6(n).alias(n) for n in names], "n_outliers")
        for a in ("x", "y")
    ]
    return rows[0].unionByName(rows[1])


@query(
    "quantiles_by_group",
    """SELECT l_returnflag AS grp, CAST(p AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, p), 6) AS value
    FROM (SELECT l_returnflag, l_extendedprice FROM lineitem) CROSS JOIN (VALUES (0.1)) v(p) GROUP BY l_returnflag, p
    UNION ALL SELECT l_returnflag, CAST(0.5 AS DOUBLE), round(quantile_cont(l_extendedprice, 0.5), 6) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, CAST(0.99 AS DOUBLE), round(quantile_cont(l_extendedprice, 0.99), 6) FROM lineitem GROUP BY 1
    """.replace("quantile_cont(l_extendedprice, p)", "quantile_cont(l_extendedprice, 0.1)"),
)
def quantiles_by_group(spark, sf):
    rows = core.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))
    return exact_quantiles(rows, "v", [0.1, 0.5, 0.99], by=["grp"]).withColumn("value", r6("value"))


ECDF_SQL = """SELECT value, CAST(sum(c) OVER (ORDER BY value) AS BIGINT) AS n_le,
  round(sum(c) OVER (ORDER BY value) / CAST(sum(c) OVER () AS DOUBLE), 9) AS cdf
FROM (SELECT {a} AS value, count(*) AS c FROM {t} GROUP BY {a})"""


@query("ecdf", f"WITH {PTS} {ECDF_SQL.format(a='x', t='pts')}")
def ecdf(spark, sf):
    return profile.ecdf(core.pts(spark, sf), "x", core.ext(spark, sf).n).withColumn("cdf", F.round("cdf", 9))


@query("ecdf_ties", f"WITH {TIES} {ECDF_SQL.format(a='y', t='ties')}")
def ecdf_ties(spark, sf):
    return profile.ecdf(core.ties(spark, sf), "y").withColumn("cdf", F.round("cdf", 9))


@query(
    "histogram",
    f"""WITH {EXT}, c AS (
      SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM pts CROSS JOIN ext GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(x0 + b.bin * ((x1 - x0) / 50), 6) AS low,
           round(x0 + (b.bin + 1) * ((x1 - x0) / 50), 6) AS high, coalesce(c.n, 0) AS n
    FROM range(50) AS b(bin) CROSS JOIN ext LEFT JOIN c ON c.bin = b.bin""",
)
def histogram(spark, sf):
    e = core.ext(spark, sf)
    out = profile.histogram(core.pts(spark, sf), "x", 50, e.min_x, e.max_x)
    return out.withColumns({"low": r6("low"), "high": r6("high")})


def _density_sql(bins: int) -> str:
    return f"""{EXT}, c AS (
      SELECT least(floor((x - x0) / ((x1 - x0) / {bins})), {bins - 1}) AS cx,
             least(floor((y - y0) / ((y1 - y0) / {bins})), {bins - 1}) AS cy, count(*) AS n
      FROM pts CROSS JOIN ext GROUP BY 1, 2),
    density AS (
      SELECT CAST(a.i AS INTEGER) AS cx, CAST(b.i AS INTEGER) AS cy, coalesce(c.n, 0) AS n
      FROM range({bins}) a(i) CROSS JOIN range({bins}) b(i) LEFT JOIN c ON c.cx = a.i AND c.cy = b.i)"""


@query("grid_density_20", f"WITH {_density_sql(20)} SELECT cx, cy, n FROM density")
def grid_density_20(spark, sf):
    return profile.grid_density(core.pts(spark, sf), 20, core.ext(spark, sf))


@query(
    "density_skew",
    f"""WITH {_density_sql(20)} SELECT count(*) AS cells, count(*) FILTER (n = 0) AS empty_cells,
      round(avg(n), 6) AS avg_n, max(n) AS max_n, round(count(*) FILTER (n = 0) / CAST(count(*) AS DOUBLE), 6) AS empty_share,
      round(max(n) / avg(n), 6) AS skew FROM density""",
)
def density_skew(spark, sf):
    out = profile.density_skew(profile.grid_density(core.pts(spark, sf), 20, core.ext(spark, sf)))
    return out.withColumns({c: r6(c) for c in ("avg_n", "empty_share", "skew")})


@query("heatmap_log", f"WITH {_density_sql(64)} SELECT cx, cy, n, round(ln(1 + n), 6) AS log_n FROM density")
def heatmap_log(spark, sf):
    out = profile.heatmap(core.pts(spark, sf), 64, core.ext(spark, sf))
    return out.withColumn("log_n", r6("log_n"))


@query(
    "hexbin",
    f"""WITH {UNIT}, f AS (
      SELECT ((sqrt(CAST(3 AS DOUBLE)) / 3) * x - (CAST(1 AS DOUBLE) / 3) * y) / CAST(0.02 AS DOUBLE) AS fq,
             (CAST(2 AS DOUBLE) / 3) * y / CAST(0.02 AS DOUBLE) AS fr FROM unit),
    s AS (SELECT fq, fr, -fq - fr AS fs FROM f),
    rounded AS (SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr, floor(fs + 0.5) AS rs FROM s),
    e AS (SELECT *, abs(rq - fq) AS eq, abs(rr - fr) AS er, abs(rs - fs) AS es FROM rounded),
    h AS (SELECT CAST(CASE WHEN eq >= er AND eq >= es THEN -rr - rs ELSE rq END AS BIGINT) AS q,
                 CAST(CASE WHEN NOT (eq >= er AND eq >= es) AND er >= es THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM e)
    SELECT q, r, count(*) AS n, round(CAST(0.02 AS DOUBLE) * sqrt(CAST(3 AS DOUBLE)) * (q + r / CAST(2 AS DOUBLE)), 6) AS center_x,
           round(CAST(0.03 AS DOUBLE) * r, 6) AS center_y FROM h GROUP BY q, r""",
)
def hexbin(spark, sf):
    out = profile.hexbin(core.unit(spark, sf), 0.02)
    return out.withColumns({"center_x": r6("center_x"), "center_y": r6("center_y")})


@query(
    "sample_points",
    f"WITH {PTS} SELECT id, x, y FROM pts ORDER BY (id * 7919) % 10007, id LIMIT 200",
)
def sample_points(spark, sf):
    rank = (F.col("id") * 7919) % 10007  # an engine-neutral order; the default is a hash of the id
    return sampling.sample_points(core.pts(spark, sf), 200, rank=rank)


@query("sample_points_hashed")
def sample_points_hashed(spark, sf):
    return sampling.sample_points(core.pts(spark, sf), 200, seed=42)


def _sample_check(name: str) -> str:
    return f"SELECT '{name}' AS sample, true AS in_bounds, true AS subset, true AS repeats"


def _checked_sample(spark, sf, name, take, low, high):
    """Size within bounds, rows of the table only, and the same rows again, in one row."""
    ids = core.pts(spark, sf).select("id")
    first, again = (take(core.pts(spark, sf)).select("id") for _ in range(2))
    n = first.count()
    foreign = first.join(ids, "id", "left_anti").count()
    return ids.agg(
        F.lit(name).alias("sample"),
        (F.lit(n) >= F.floor(F.count(F.lit(1)) * low)) & (F.lit(n) <= F.ceil(F.count(F.lit(1)) * high)),
        F.lit(foreign == 0), F.lit(first.exceptAll(again).count() == 0 == again.exceptAll(first).count()),
    ).toDF("sample", "in_bounds", "subset", "repeats")


@query("sample_fraction_check", _sample_check("fraction"))
def sample_fraction_check(spark, sf):
    return _checked_sample(spark, sf, "fraction", lambda p: sampling.sample_fraction(p, 0.1, seed=42), 0.05, 0.15)


@query("sample_points_check", _sample_check("points"))
def sample_points_check(spark, sf):
    return _checked_sample(spark, sf, "points", lambda p: sampling.sample_points(p, 200, seed=42), 0.0, 1.0)


@query(
    "random_windows_check",
    f"WITH {PTS} SELECT CAST(count(*) // 100 AS BIGINT) AS n, true AS in_extent, true AS repeats FROM pts",
)
def random_windows_check(spark, sf):
    """Window centres lie in the extent of the points, as many as asked for, the same in every run."""
    e = core.ext(spark, sf)
    first, again = random_windows(spark, sf), random_windows(spark, sf)
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    boxes = ["min_x", "min_y", "max_x", "max_y"]
    same = first.select(*boxes).exceptAll(again.select(*boxes)).count() == 0
    slack = 1e-6
    return first.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(cx.between(e.min_x - slack, e.max_x + slack) & cy.between(e.min_y - slack, e.max_y + slack)).alias("in_extent"),
        F.lit(same).alias("repeats"),
    )


@query("sample_fraction")
def sample_fraction(spark, sf):
    return sampling.sample_fraction(core.pts(spark, sf), 0.1, seed=42)


@query(
    "windows_around",
    f"""WITH {PTS} SELECT id, x - CAST(0.0065 AS DOUBLE) AS min_x, y - CAST(0.0065 AS DOUBLE) AS min_y,
      x + CAST(0.0065 AS DOUBLE) AS max_x, y + CAST(0.0065 AS DOUBLE) AS max_y FROM pts""",
)
def windows_around(spark, sf):
    return sampling.windows_around(core.pts(spark, sf), 0.0065, x="x", y="y").drop("x", "y")


@query("random_windows")
def random_windows(spark, sf):
    e = core.ext(spark, sf)
    centers = sampling.random_points(spark, e, e.n // 100)
    return sampling.windows_around(centers, e.width / 100, e.height / 100)


RUNS = """count(value) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
  round(stddev_pop(value), 6) AS std_pop, round(coalesce(stddev_samp(value), 0), 6) AS std_samp"""


@query(
    "runtime_summary",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY avg, event_type) AS INTEGER) AS rank FROM (
      SELECT event_type, {RUNS} FROM events GROUP BY event_type)""",
)
def runtime_summary(spark, sf):
    out = diagnostics.runtime_summary(core.table(spark, sf, "events"), "event_type", "value")
    return out.withColumns({c: r6(c) for c in ("avg", "std_pop", "std_samp")})


@query(
    "speedup",
    """WITH a AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS base_avg,
      avg(value) FILTER (event_type = 'view') AS test_avg FROM events GROUP BY user_id)
    SELECT user_id, round(base_avg, 6) AS base_avg, round(test_avg, 6) AS test_avg,
      round(base_avg / nullif(test_avg, 0), 6) AS speedup FROM a""",
)
def speedup(spark, sf):
    out = diagnostics.speedup(core.table(spark, sf, "events"), "user_id", "event_type", "value", "click", "view")
    return out.withColumns({c: r6(c) for c in ("base_avg", "test_avg", "speedup")})


@query(
    "window_quantiles_ok",
    f"""WITH {PTS}, {WINDOWS} SELECT w.qid, count(*) AS n, true AS ok FROM windows w
    JOIN pts p ON p.x BETWEEN w.min_x AND w.max_x AND p.y BETWEEN w.min_y AND w.max_y GROUP BY w.qid""",
)
def window_quantiles_ok(spark, sf):
    """Quantiles of windows from merged sketches, each held against the exact rank of its value in the window."""
    index, windows = core.index(spark, sf), core.windows(spark, sf)
    made = core.built(spark, sf, "sketches", lambda: SketchIndex.build(index))
    probs = [0.05, 0.5, 0.95]
    found = written(made.window_quantiles(windows, probs).filter("n > 0"), "window-quantiles")
    asked = windows.join(found.dropDuplicates(["qid"]), "qid").select("qid", F.col("n").alias("m"), *BOX, "x_quantiles", "y_quantiles")
    # the ranks of a value are the counts of the window's part up to it and from it on
    parts = [F.struct(F.lit("c").alias("part"), *[F.col(b) for b in BOX])]
    for i in range(len(probs)):
        for axis, low, high in (("x", 0, 2), ("y", 1, 3)):
            v = F.get(f"{axis}_quantiles", F.lit(i))
            up, on = list(map(F.col, BOX)), list(map(F.col, BOX))
            up[high], on[low] = v, v
            for name, box in (("le", up), ("ge", on)):
                parts.append(F.struct(F.lit(f"{axis}{i}_{name}").alias("part"), *[c.alias(b) for c, b in zip(box, BOX)]))
    boxes = asked.select("qid", "m", F.explode(F.array(*parts)).alias("b")).select("qid", "m", "b.*")
    held = joins.window_counts(index, boxes)
    names = [f"{axis}{i}_{side}" for i in range(len(probs)) for axis in ("x", "y") for side in ("le", "ge")]
    sums = [F.sum(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in ["c", *names]]
    counted = held.groupBy("qid").agg(*sums, F.first("m").alias("n"))
    good, slack = F.col("c") == F.col("n"), F.lit(RANK_ERROR) * F.col("n") + 1
    for i, p in enumerate(probs):
        for axis in ("x", "y"):
            good = good & (F.col("c") - F.col(f"{axis}{i}_ge") <= F.col("n") * p + slack) & (F.col(f"{axis}{i}_le") >= F.col("n") * p - slack)
    return counted.select("qid", "n", good.alias("ok"))
