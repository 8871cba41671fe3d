"""Order-preserving buckets and ranges, and global running sums and row numbers built on them.

A window without ``partitionBy`` puts the whole table into one task. Here rows are range-partitioned by the whole
sort order first, so rows that agree on the first key are still spread by the others; every range is sorted, its
total becomes an offset for the ranges behind it, and only rows that agree on every sort key stay together.

Buckets are the same idea as a column, for joins by range: a value that holds a large share of the rows gets a
bucket of its own, which is then cut again on the next sort key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.values import known
from terrafold.plans.session import bounded_broadcast, written

ROWS_PER_BUCKET = 50_000
ROWS_PER_RANGE = 2_000_000
MIN_BUCKETS = 4
PART, POS = "__part", "__pos"
SAMPLES_PER_PART = 64
MIN_SAMPLE = 20_000
SAMPLE_SEED = 42


def bucket_count(n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(MIN_BUCKETS, math.ceil(n / rows_per_bucket))


@dataclass(frozen=True)
class Cuts:
    """Ascending interior cut values of one column. Bucket i is [values[i-1], values[i])."""

    values: tuple[float, ...]
    heavy: tuple[int, ...] = ()  # buckets that hold exactly one column value

    @property
    def buckets(self) -> int:
        return len(self.values) + 1

    @property
    def splits(self) -> list[float]:
        return [-math.inf, *self.values, math.inf]

    @property
    def fences(self) -> Cuts:
        """Only the cuts around heavy values: a value is heavy when it falls into an odd bucket of these."""
        return Cuts(tuple(v for b in self.heavy for v in self.values[b - 1 : b + 1]))

    @classmethod
    def from_quantiles(cls, quantiles) -> Cuts:
        """Cuts from evenly spaced quantiles. A value drawn twice holds a whole share: it is fenced in."""
        finite = sorted(q for q in quantiles if math.isfinite(q))
        repeated = {a for a, b in zip(finite, finite[1:]) if a == b}
        values = sorted(set(finite) | {math.nextafter(v, math.inf) for v in repeated})
        at = {v: i + 1 for i, v in enumerate(values)}
        return cls(tuple(values), tuple(at[v] for v in sorted(repeated)))


def fit_quantiles(df: DataFrame, columns: list[str], parts: int, n: int, seed: int = SAMPLE_SEED) -> list[list[float]]:
    """Evenly spaced quantiles of several columns from one sample of bounded size.

    Cuts only steer the distribution of work, never a result, so a sample is enough: SAMPLES_PER_PART values
    per part and column, sorted on the driver, the way Spark finds the bounds of a range partitioning.
    """
    wanted = max(MIN_SAMPLE, SAMPLES_PER_PART * parts)
    source = df.select(*[F.col(name).cast("double").alias(f"q{i}") for i, name in enumerate(columns)])
    if n > wanted:
        source = source.sample(False, wanted / n, seed)
    drawn = source.toArrow()
    out = []
    for i in range(len(columns)):
        values = drawn.column(f"q{i}").drop_null().to_numpy()
        values = np.sort(values[np.isfinite(values)])
        ranks = np.ceil(np.arange(1, parts) / parts * len(values)).astype(int) - 1
        out.append([float(v) for v in values[np.maximum(ranks, 0)]] if len(values) else [])
    return out


def fit_cuts(df: DataFrame, columns: list[str], buckets: int, n: int) -> list[Cuts]:
    return [Cuts.from_quantiles(q) for q in fit_quantiles(df, columns, buckets, n)]


def add_buckets(df: DataFrame, **targets: tuple[str, Cuts]) -> DataFrame:
    """Add integer bucket columns, ``name=(column, cuts)``; a JVM-side binary search per value. Values that are
    not finite have no bucket."""
    names = list(targets)
    staged, source = [f"__{n}_bucket" for n in names], [f"__{n}_value" for n in names]
    stage = Bucketizer(
        inputCols=source,
        outputCols=staged,
        splitsArray=[targets[n][1].splits if targets[n][1].values else [-math.inf, 0.0, math.inf] for n in names],
        handleInvalid="keep",
    )
    whole = {
        name: F.col(tmp).cast("int") if targets[name][1].values else F.when(F.col(v).isNotNull(), F.lit(0))
        for name, tmp, v in zip(names, staged, source)
    }
    # Bucketizer keeps NaN in a bucket of its own, one past the last
    whole = {name: F.when(F.col(v).isNotNull(), b) for (name, b), v in zip(whole.items(), source)}
    values = {v: known(targets[n][0]) for n, v in zip(names, source)}
    return stage.transform(df.withColumns(values)).withColumns(whole).drop(*staged, *source)


@dataclass(frozen=True)
class RangeOrder:
    """Buckets consistent with sorting by ``columns``."""

    columns: tuple[str, ...]
    cuts: tuple[Cuts, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], n: int | None = None, buckets: int | None = None) -> RangeOrder:
        if n is None:
            n = df.count()
        b = buckets or bucket_count(n)
        return cls(tuple(columns), tuple(fit_cuts(df, columns, b, n)))

    @property
    def names(self) -> list[str]:
        return [f"__b{i}" for i in range(self.depth)]

    @property
    def depth(self) -> int:
        d = 1
        while d < len(self.columns) and self.cuts[d - 1].heavy:
            d += 1
        return d

    def add(self, df: DataFrame) -> DataFrame:
        """Add the bucket columns; a level below a bucket of many values is -1."""
        d = self.depth
        places = {f"__b{i}": (self.columns[i], self.cuts[i]) for i in range(d)}
        fences = {f"__h{i}": (self.columns[i], self.cuts[i].fences) for i in range(d - 1)}
        out = add_buckets(df, **places, **fences)
        staged = {"__b0": F.coalesce("__b0", F.lit(-1))}  # nulls sort first
        single = F.lit(True)
        for i in range(1, d):
            single = single & (F.col(f"__h{i - 1}") % 2 == 1)
            staged[f"__b{i}"] = F.coalesce(F.when(single, F.col(f"__b{i}")), F.lit(-1))
        return out.withColumns(staged).drop(*fences)


def in_ranges(df: DataFrame, order: list[str], n: int | None = None, parts: int | None = None) -> tuple[DataFrame, int]:
    """(``df`` in sorted ranges of ``order``, number of ranges): adds ``__part``, ascending along the order, and
    ``__pos``, the 0-based place inside the range.

    One range partitioning, sorted and written: Spark finds the borders from its own sample, a lost executor
    costs a task of it, and nothing later depends on the borders being found again.
    """
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((n or 0) / ROWS_PER_RANGE))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is the task's number and, below it, the row's number in the task
    placed = written(spread.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    at = F.col("__at")
    return placed.withColumns({PART: F.shiftright(at, 33).cast("int"), POS: at.bitwiseAND(2**33 - 1)}).drop("__at"), parts


def _offsets(placed: DataFrame, parts: int, by: list[str], total: Column) -> DataFrame:
    """Per range and group: ``__first`` place, and ``__o``, the sum of ``total`` of the group's earlier ranges."""
    before = (Window.partitionBy(*by) if by else Window).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(PART, *by).agg(F.min(POS).alias("__first"), total.alias("__t"))
    out = sums.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    if not by:
        return bounded_broadcast(out, parts)  # one row per range
    out = written(out, "offsets")
    return bounded_broadcast(out, out.count())


def running_total(
    df: DataFrame,
    order: list[str],
    value: Column,
    name: str,
    by: list[str] | None = None,
    buckets: RangeOrder | None = None,
    n: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` (a total order) within ``by``. ``buckets`` only gives the
    number of ranges."""
    by = by or []
    placed, parts = in_ranges(df.withColumn("__v", value), [*by, *order], n, _parts(buckets))
    inside = Window.partitionBy(PART, *by).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumn("__l", F.sum("__v").over(inside))
        .transform(_join_groups, _offsets(placed, parts, by, F.sum("__v")), [PART, *by])
        .withColumn(name, F.col("__l") + F.col("__o"))
        .drop("__v", "__l", "__o", "__first", PART, POS)
    )


def _parts(buckets: RangeOrder | None) -> int | None:
    return buckets.cuts[0].buckets if buckets else None


def _join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys`` with null equal to null, so that a null group stays a group."""
    other = {k: f"__g_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{v}`")) for k, v in other.items()])
    return rows.join(groups.withColumnsRenamed(other), on).drop(*other.values())


def number_rows(
    df: DataFrame,
    order: list[str],
    name: str = "row_no",
    by: list[str] | None = None,
    buckets: RangeOrder | None = None,
    n: int | None = None,
) -> DataFrame:
    """0-based position of every row in ``order`` within ``by``; columns of any sortable type, nulls first.

    The rows are shuffled once, by range; the rest is their place in the range and a small table of offsets."""
    by = by or []
    placed, parts = in_ranges(df, [*by, *order], n, _parts(buckets))
    offsets = _offsets(placed, parts, by, F.count(F.lit(1)))
    out = placed.transform(_join_groups, offsets, [PART, *by])
    return out.withColumn(name, F.col(POS) - F.col("__first") + F.col("__o")).drop("__first", "__o", PART, POS)


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: list[float],
    by: list[str] | None = None,
    buckets: RangeOrder | None = None,
    n: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (by..., prob, value).

    Equal values are counted before anything is ordered. Totals of value ranges tell which ranges hold the
    wanted ranks, and running counts are taken in those only.
    """
    by = by or []
    known = df.filter(F.col(column).isNotNull()).select(*by, column)
    counts = known.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    placed, _ = in_ranges(counts, [*by, column], n, _parts(buckets))
    keys = [PART, *by]

    def rank(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(p))

    def wanted(first: Column, end: Column) -> Column:
        """Does [first, end) hold a rank that some quantile needs?"""
        marks = [r for p in probs for r in (F.floor(rank(p)), F.ceil(rank(p)))]
        return reduce(lambda a, b: a | b, [(m >= first) & (m < end) for m in marks])

    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # rows are totals of ranges
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys).agg(F.sum("__n").alias("__t")).withColumns({
        "__o": F.coalesce(F.sum("__t").over(before), F.lit(0)), "__total": F.sum("__t").over(group)
    })
    needed = totals.filter(wanted(F.col("__o"), F.col("__o") + F.col("__t"))).drop("__t")
    inside = Window.partitionBy(*keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _join_groups(placed, needed, keys).withColumn("__cum", F.col("__o") + F.sum("__n").over(inside))

    def holds(position: Column) -> Column:
        """Is this 0-based rank one of the ranks of this row's value?"""
        return (position >= F.col("__cum") - F.col("__n")) & (position < F.col("__cum"))

    value = F.col(column).cast("double")
    parts = []
    for i, p in enumerate(probs):
        parts += [
            F.max(F.when(holds(F.floor(rank(p))), value)).alias(f"__low{i}"),
            F.max(F.when(holds(F.ceil(rank(p))), value)).alias(f"__high{i}"),
            F.max(rank(p) - F.floor(rank(p))).alias(f"__share{i}"),
        ]
    between = F.array(*[
        F.struct(
            F.lit(float(p)).alias("prob"),
            (F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__share{i}")).alias("value"),
        )
        for i, p in enumerate(probs)
    ])
    hits = rows.filter(wanted(F.col("__cum") - F.col("__n"), F.col("__cum")))
    out = hits.groupBy(*by).agg(*parts).select(*by, F.inline(between))
    return out.filter(F.col("value").isNotNull())


def with_neighbours(df: DataFrame, number: str, chunk: int, by: list[str] | None = None) -> DataFrame:
    """Split numbered rows into chunks and copy each chunk's border rows into the adjacent chunk.

    Adds ``__chunk`` and ``__own``. Windows partitioned by (by, __chunk) then see the previous and the next
    row of every owned row, and no task gets a whole group.
    """
    no = F.col(number)
    own = F.floor(no / F.lit(chunk)).cast("bigint")
    homes = F.array_distinct(F.array(own, F.floor((no - 1) / F.lit(chunk)).cast("bigint"), F.floor((no + 1) / F.lit(chunk)).cast("bigint")))
    return (
        df.withColumn("__home", own)
        .withColumn("__chunk", F.explode(homes))
        .withColumn("__own", F.col("__chunk") == F.col("__home"))
        .drop("__home")
    )
