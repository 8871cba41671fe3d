"""Counts and order statistics of many boxes in one part of the points: a wavelet tree over ranks, in Numpy.

Spark deals points and pairs by part (``PointIndex.in_parts``); a task holds one part, which has a bounded number of rows
whatever the table's size, and a bounded number of the windows that cut it. A window costs a step per bit of the part's
size, not a test per point.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.values import known
from terrafold.plans.pyramid import SALT, PointIndex
from terrafold.plans.session import bounded_broadcast, written

PART_ROWS = 262_144  # points of a part, unless they are one place
ASKED_ROWS = 262_144  # windows that one task takes with a part
WINDOWS_PER_CALL = 4_096
PARTS_PER_GROUP = 8_192
WINDOW = tuple(f"w_{b}" for b in ("min_x", "min_y", "max_x", "max_y"))

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Ranks:
    """The ranks by one axis of points in the order of the other."""

    def __init__(self, along: np.ndarray, across: np.ndarray):
        order = np.argsort(across, kind="stable")
        by_rank = np.argsort(along[order], kind="stable")
        self.across, self.along = across[order], along[order][by_rank]
        ranks = np.empty(len(order), np.int32)
        ranks[by_rank] = np.arange(len(order), dtype=np.int32)
        self.bits = []
        for bit in reversed(range(len(order).bit_length())):
            one = (ranks >> bit) & 1 == 1
            self.bits.append((bit, np.concatenate(([0], np.cumsum(~one))).astype(np.int32)))
            ranks = np.concatenate((ranks[~one], ranks[one]))

    def below(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the points at places ``low`` to ``high`` have a smaller rank."""
        found = np.zeros(len(rank), np.int64)
        for bit, zeros in self.bits:
            a, b, one = zeros[low], zeros[high], (rank >> bit) & 1 == 1
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value whose rank is the n-th smallest (from 0) at places ``low`` to ``high``."""
        rank = np.zeros(len(n), np.int64)
        for bit, zeros in self.bits:
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            n, rank = np.where(one, n - (b - a), n), rank | (one.astype(np.int64) << bit)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return self.along[rank]

    def window(self, along: tuple[np.ndarray, np.ndarray], across: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(low, high, points before, points inside) of closed windows."""
        low, high = np.searchsorted(self.across, across[0], "left"), np.searchsorted(self.across, across[1], "right")
        first, end = (np.searchsorted(self.along, v, side) for v, side in zip(along, ("left", "right")))
        before = self.below(low, high, first)
        return low, high, before, self.below(low, high, end) - before


def bounds(windows: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((min_x, max_x), (min_y, max_y)) of the windows."""
    a, b, c, d = (windows.column(w).to_numpy() for w in WINDOW)
    return (a, c), (b, d)


def by_part(
    index: PointIndex, pairs: DataFrame, keep: list[str], made: list[str], answer: Callable[[np.ndarray, np.ndarray, pa.Table], list[pa.Array]],
    part_rows: int,
) -> DataFrame:
    """Rows (keep..., made...) of pairs (keep..., WINDOW, level, nx, ny) of a walk that ended at parts of ``part_rows``.

    ``answer`` gets the coordinates of a part and a table of pairs, and returns the ``made`` columns (DDL) of those.
    A part that very many windows cut is copied, once per ASKED_ROWS of them.
    """
    node = ["level", "nx", "ny"]
    asked = written(pairs.groupBy(*node).agg(F.ceil(F.count(F.lit(1)) / ASKED_ROWS).cast("int").alias("__deals")), "asked-parts")
    light = asked.count()
    finest = len(index.grid.shifts) - 1
    salt = F.when(F.col("level") == finest, F.col(SALT)).otherwise(0).alias("__part")
    points = index.in_parts(index.touched(pairs, index.points).filter("bx IS NOT NULL AND by IS NOT NULL"), part_rows)
    points = points.select(*node, salt, known("x").alias("x"), known("y").alias("y")).join(bounded_broadcast(asked, light), node)
    points = points.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
    left = pairs.select(*keep, *[F.col(w).cast("double").alias(w) for w in WINDOW if w not in keep], *node)
    left = left.join(bounded_broadcast(asked, light), node)
    left = left.withColumn("__deal", F.pmod(F.xxhash64(*keep, *WINDOW), F.col("__deals")).cast("int")).drop("__deals")
    if index.hot is None:
        left = left.withColumn("__part", F.lit(0))
    else:
        here = (F.col("nx") == F.col("hx")) & (F.col("ny") == F.col("hy")) & (F.col("level") == finest)
        parts = F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)
        left = left.join(index.hot.drop("single"), here, "left").withColumn("__part", F.explode(parts)).drop("hx", "hy", "splits")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*keep).schema], *made])

    def settle(points: pa.Table, windows: pa.Table) -> pa.Table:
        x, y = (points.column(a).to_numpy() for a in ("x", "y"))
        kept = windows.select(keep)
        for name, column in zip(made, answer(x, y, windows)):
            kept = kept.append_column(name.split()[0], column)
        return kept

    key = [*node, "__part", "__deal"]
    return points.groupBy(*key).cogroup(left.groupBy(*key)).applyInArrow(settle, schema)


def count_in_parts(index: PointIndex, pairs: DataFrame, keep: list[str], part_rows: int) -> DataFrame:
    """Rows (keep..., n): the points of each pair's part that lie in its window."""

    def answer(x: np.ndarray, y: np.ndarray, windows: pa.Table) -> list[pa.Array]:
        across, along = bounds(windows)
        return [pa.array(Ranks(y, x).window(along, across)[3] if len(windows) else np.zeros(0, np.int64))]

    return by_part(index, pairs, keep, ["n bigint"], answer, part_rows)


def marks_in_parts(index: PointIndex, pairs: DataFrame, keep: list[str], part_rows: int, marks: int) -> DataFrame:
    """Rows (keep..., n, x, y): of the points of each pair's part in its window their number and, per axis, ``marks``
    values that stand for equal shares of them, each the middle one of its share, or all values of fewer points."""

    def answer(x: np.ndarray, y: np.ndarray, windows: pa.Table) -> list[pa.Array]:
        if not len(windows):
            return [pa.array([], pa.int64()), *[pa.array([], pa.list_(pa.float64()))] * 2]
        out = []
        xs, ys = bounds(windows)
        for ranks, along, across in ((Ranks(x, y), xs, ys), (Ranks(y, x), ys, xs)):
            low, high, before, n = ranks.window(along, across)
            taken = np.minimum(n, marks)
            values = np.empty(taken.sum())
            ends = np.concatenate(([0], np.cumsum(taken)))
            for i in range(0, len(n), WINDOWS_PER_CALL):
                of = np.repeat(np.arange(i, min(i + WINDOWS_PER_CALL, len(n))), taken[i : i + WINDOWS_PER_CALL])
                place = np.arange(ends[i], ends[i] + len(of)) - ends[of]
                nth = before[of] + (2 * place + 1) * n[of] // (2 * taken[of])
                values[ends[i] : ends[i] + len(of)] = ranks.nth(low[of], high[of], nth)
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))
        return [pa.array(n), *out]

    return by_part(index, pairs, keep, ["n bigint", "x array<double>", "y array<double>"], answer, part_rows)


def merged_quantiles(marked: DataFrame, key: str, probs: list[float]) -> DataFrame:
    """Rows (key, n, x_quantiles, y_quantiles) from rows (key, n, x, y) whose values each stand for an equal share of n.

    Keys are dealt by hash into groups of some PARTS_PER_GROUP rows, and a group is merged at once."""
    groups = max(1, -(-marked.count() // PARTS_PER_GROUP))
    dealt = marked.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(groups)))

    def merge(rows: pa.Table) -> pa.Table:
        coded = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        number, n = coded.indices.to_numpy(), rows.column("n").to_numpy()
        total = np.bincount(number, n, len(coded.dictionary)).astype(np.int64)
        out = [coded.dictionary, pa.array(total)]
        for axis in ("x", "y"):
            lists = rows.column(axis).combine_chunks()
            sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            of, weight = np.repeat(number, sizes), np.repeat(n / np.maximum(sizes, 1), sizes)
            order = np.lexsort((values, of))
            of, values, weight = of[order], values[order], np.cumsum(weight[order])
            first = np.searchsorted(of, np.arange(len(total)), "left")
            last = np.searchsorted(of, np.arange(len(total)), "right") - 1
            before = np.concatenate(([0.0], weight))[first]
            found = [np.clip(np.searchsorted(weight, before + p * total), first, last) for p in probs]
            flat = values[np.stack(found, axis=1).ravel()]
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * len(probs), pa.int32()), pa.array(flat)))
        return pa.Table.from_arrays(out, names=[key, "n", "x_quantiles", "y_quantiles"])

    kind = marked.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n bigint, x_quantiles array<double>, y_quantiles array<double>"
    return dealt.select("__group", key, "n", "x", "y").groupBy("__group").applyInArrow(merge, schema)
