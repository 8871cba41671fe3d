"""Distribution models per cell: cumulative counts along y, linear-piece fits, rank and count estimates."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.plans.ordering import RangeOrder, number_rows, running_total, with_neighbours
from terrafold.plans.session import written

# Fixed value: default error bound of a fit, in ranks.
MAX_ERROR = 32

KEYS_PER_CHUNK = 100_000

# The fit functions travel to the executors by value, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cdf(points: DataFrame, key: str = "y", cell: str = "cell_id", n: int | None = None) -> DataFrame:
    """Rows (cell, key, rank): 0-based rank of the last occurrence of each distinct key in its cell."""
    counts = points.groupBy(cell, F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    run = running_total(counts, ["key"], F.col("c"), "cum", by=[cell], n=n)
    return run.select(cell, "key", (F.col("cum") - 1).cast("bigint").alias("rank"))


def numbered_cdf(model: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Add ``key_no``, the 0-based position of a key among the distinct keys of its cell."""
    return number_rows(model, ["key"], "key_no", by=[cell])


# ---------------------------------------------------------------- exact knots


def lossless_knots(model: DataFrame, cell: str = "cell_id", chunk: int = KEYS_PER_CHUNK) -> DataFrame:
    """Keys where the cumulative curve bends, with the first and the last key of every cell."""
    staged = with_neighbours(numbered_cdf(model, cell), "key_no", chunk, [cell])
    w = Window.partitionBy(cell, "__chunk").orderBy("key")
    k, r = F.col("key"), F.col("rank")
    pk, pr, nk, nr = F.lag(k).over(w), F.lag(r).over(w), F.lead(k).over(w), F.lead(r).over(w)
    bend = (k - pk) * (nr - r).cast("double") != (nk - k) * (r - pr).cast("double")
    return (
        staged.withColumn("bend", F.coalesce(bend, F.lit(True)))
        .filter(F.col("__own") & F.col("bend"))
        .select(cell, "key", "rank")
    )


def segment_slopes(knots: DataFrame, cell: str = "cell_id", chunk: int = KEYS_PER_CHUNK) -> DataFrame:
    """Segments (cell, key, rank, next_key, next_rank, slope) between consecutive knots."""
    return _segments(stored(knots, "knots"), cell, chunk)


def _segments(knots: DataFrame, cell: str, chunk: int = KEYS_PER_CHUNK) -> DataFrame:
    staged = with_neighbours(number_rows(knots, ["key"], "knot_no", by=[cell]), "knot_no", chunk, [cell])
    w = Window.partitionBy(cell, "__chunk").orderBy("key")
    return (
        staged.withColumns({"next_key": F.lead("key").over(w), "next_rank": F.lead("rank").over(w)})
        .filter(F.col("__own") & F.col("next_key").isNotNull())
        .withColumn("slope", (F.col("next_rank") - F.col("rank")) / (F.col("next_key") - F.col("key")))
        .select(cell, "key", "rank", "next_key", "next_rank", "slope")
    )


# ---------------------------------------------------------------- bounded-error fit


def corridor(keys: np.ndarray, ranks: np.ndarray, error: float) -> np.ndarray:
    """Positions of knots such that straight lines between them miss no rank by more than ``error``.

    From each knot the range of slopes that serves all keys so far is kept; the last key whose own slope is
    still in range ends the piece. Keys are looked at in blocks that grow as long as the piece does.
    """
    last = len(keys) - 1
    chosen = [0]
    base = 0
    while base < last:
        low, high, end, size, pos = -np.inf, np.inf, base + 1, 64, base + 1
        while pos <= last:
            stop = min(last + 1, pos + size)
            dx = keys[pos:stop] - keys[base]
            dy = ranks[pos:stop] - ranks[base]
            lows = np.maximum.accumulate(np.concatenate(([low], (dy - error) / dx)))
            highs = np.minimum.accumulate(np.concatenate(([high], (dy + error) / dx)))
            slope = dy / dx
            out = np.flatnonzero((slope < lows[:-1]) | (slope > highs[:-1]))
            if len(out):
                end = max(base + 1, pos + int(out[0]) - 1)
                break
            low, high, end = lows[-1], highs[-1], stop - 1
            pos, size = stop, size * 2
        chosen.append(end)
        base = end
    return np.asarray(chosen)


def fit_knots(
    model: DataFrame, error: float | Column = MAX_ERROR, cell: str = "cell_id", chunk: int = KEYS_PER_CHUNK
) -> DataFrame:
    """Knots (cell, key, rank) of a piecewise-linear fit with a guaranteed maximum error at the keys.

    A cell is fitted in chunks of at most ``chunk`` keys, so no task ever holds a whole cell; each chunk keeps
    its end points, and the step between two chunks joins neighbouring keys, where it is exact.
    """
    bound = error if isinstance(error, Column) else F.lit(float(error))
    numbered = numbered_cdf(model, cell).withColumns({
        "chunk": F.floor(F.col("key_no") / F.lit(chunk)).cast("bigint"), "error": bound.cast("double")
    })
    cell_type = dict(model.dtypes)[cell]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        at = corridor(pdf["key"].to_numpy(float), pdf["rank"].to_numpy(float), float(pdf["error"].iloc[0]))
        return pdf.iloc[at][[cell, "key", "rank"]]

    return (
        numbered.select(cell, "chunk", "key", "rank", "error")
        .groupBy(cell, "chunk")
        .applyInPandas(fit, f"{cell} {cell_type}, key double, rank bigint")
    )


def smallest_fit(keys: np.ndarray, ranks: np.ndarray, max_knots: int) -> np.ndarray:
    """Knots of the smallest error 2^i, found by bisection, that needs at most ``max_knots`` of them.

    An error of the whole rank span needs two knots, so there always is one."""
    low, high = 0, max(0, math.ceil(math.log2(max(1.0, ranks[-1] - ranks[0]))))
    best = corridor(keys, ranks, 2.0**high)
    while low < high:
        middle = (low + high) // 2
        found = corridor(keys, ranks, 2.0**middle)
        if len(found) <= max_knots:
            high, best = middle, found
        else:
            low = middle + 1
    return best


def fit_within_size(
    model: DataFrame, max_knots: int, cell: str = "cell_id", chunk: int = KEYS_PER_CHUNK
) -> DataFrame:
    """Fit every cell with at most ``max_knots`` knots (two or more), however many keys it has.

    Chunks of at most ``chunk`` keys are fitted to the size each; the knots that remain are numbered and fitted
    again in chunks until a cell is one chunk, so a round divides the rows of a cell by chunk / max_knots and no
    task holds more than a chunk. Knots lie on the curve, so the errors of the rounds add up.
    """
    if max_knots < 2 or chunk < 2 * max_knots:
        raise ValueError("take at least two knots, and chunks of at least twice as many keys")
    cell_type = dict(model.dtypes)[cell]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        at = smallest_fit(pdf["key"].to_numpy(float), pdf["rank"].to_numpy(float), max_knots)
        return pdf.iloc[at][[cell, "chunk", "key", "rank"]]

    knots = model
    while True:
        numbered = numbered_cdf(knots.select(cell, "key", "rank"), cell)
        numbered = numbered.withColumn("chunk", F.floor(F.col("key_no") / F.lit(chunk)).cast("bigint"))
        fitted = (
            numbered.select(cell, "chunk", "key", "rank")
            .groupBy(cell, "chunk")
            .applyInPandas(fit, f"{cell} {cell_type}, chunk bigint, key double, rank bigint")
        )
        knots = stored(fitted, "knots")
        if not knots.agg(F.max("chunk")).first()[0]:
            return knots.select(cell, "key", "rank")


# ---------------------------------------------------------------- estimates


def estimate_rank(
    knots: DataFrame, keys: DataFrame, cell: str = "cell_id", buckets: RangeOrder | None = None
) -> DataFrame:
    """Add ``est``, the interpolated rank of every (cell, key) row.

    0 below the first knot and the last rank above the last one. Knots and keys meet in one sorted pass per
    (cell, key range); a segment that starts in an earlier range is repeated at the start of each range it
    crosses, so ranges are independent of each other.
    """
    knots = stored(knots, "knots")
    asked, keys = keys, keys.select(cell, "key").distinct()  # a key that many rows ask is looked up once
    segments = _segments(knots, cell).select(
        cell, F.col("key").alias("k0"), F.col("rank").alias("r0"), F.col("next_key").alias("k1"), "slope"
    )
    ends = knots.groupBy(cell).agg(
        F.min("key").alias("k_first"), F.max("key").alias("k_last"),
        F.min("rank").alias("r_first"), F.max("rank").alias("r_last"),
    )
    ranges = buckets or RangeOrder.fit(knots, ["key"])
    first = ranges.add(segments.withColumn("key", F.col("k0"))).withColumnRenamed("__b0", "b_from")
    both = ranges.add(first.withColumn("key", F.col("k1"))).withColumnRenamed("__b0", "b_to")
    spread = both.withColumn("__b0", F.explode(F.sequence("b_from", "b_to")))
    carried = spread.select(
        cell,
        "__b0",
        F.when(F.col("__b0") > F.col("b_from"), F.lit(float("-inf"))).otherwise(F.col("k0")).alias("at"),
        F.lit(0).alias("kind"),
        F.struct("k0", "r0", "slope").alias("seg"),
    )
    rows = ranges.add(keys).select(
        cell, "__b0", F.col("key").alias("at"), F.lit(1).alias("kind"), F.struct(*keys.columns).alias("row")
    )
    w = Window.partitionBy(cell, "__b0").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = rows.unionByName(carried, allowMissingColumns=True)
    found = merged.withColumn("seg", F.last("seg", ignorenulls=True).over(w)).filter(F.col("kind") == 1)
    key = F.col("key")
    est = (
        F.when(key <= F.col("k_first"), F.when(key < F.col("k_first"), F.lit(0.0)).otherwise(F.col("r_first").cast("double")))
        .when(key >= F.col("k_last"), F.col("r_last").cast("double"))
        .otherwise(F.col("seg.r0") + (key - F.col("seg.k0")) * F.col("seg.slope"))
    )
    known = found.select("row.*", "seg").join(ends, cell).withColumn("est", est).select(F.col(cell).alias("__cell"), F.col("key").alias("__key"), "est")
    return asked.drop("est").join(known, (F.col(cell) == F.col("__cell")) & (F.col("key") == F.col("__key"))).select(*[c for c in asked.columns if c != "est"], "est")


def fit_error(knots: DataFrame, model: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Average and maximum absolute error per cell over all distinct keys: (cell, n_keys, avg_error, max_error)."""
    miss = F.abs(F.col("est") - F.col("rank"))
    return estimate_rank(knots, model, cell).groupBy(cell).agg(
        F.count(F.lit(1)).alias("n_keys"), F.avg(miss).alias("avg_error"), F.max(miss).alias("max_error")
    )


def approximate_range_count(knots: DataFrame, low: float, high: float, cell: str = "cell_id") -> DataFrame:
    """Estimated number of keys in [low, high] per cell: est(high) - est(low), at least 0."""
    ask = knots.select(cell).distinct().select(
        cell, F.explode(F.array(F.lit(float(low)), F.lit(float(high)))).alias("key")
    )
    est = estimate_rank(knots, ask, cell)
    at_high = F.max(F.when(F.col("key") == F.lit(float(high)), F.col("est")))
    at_low = F.min(F.when(F.col("key") == F.lit(float(low)), F.col("est")))
    return est.groupBy(cell).agg(F.greatest(F.lit(0.0), at_high - at_low).alias("est_n"))


def model_size(knots: DataFrame, model: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Knots and keys per cell, and keys per knot."""
    k = knots.groupBy(cell).agg(F.count(F.lit(1)).alias("knots"))
    m = model.groupBy(cell).agg(F.count(F.lit(1)).alias("keys"))
    return m.join(k, cell).withColumn("keys_per_knot", F.col("keys") / F.col("knots"))


def stored(model: DataFrame, name: str = "model") -> DataFrame:
    """Write a model (small: keys or knots per cell) to shared storage so that later steps do not rebuild it."""
    return written(model, name)

