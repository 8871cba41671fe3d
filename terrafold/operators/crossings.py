"""How many edges the rays of points cross, layer by layer."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS_PER_CALL = 4_000_000


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Cut a list of sizes into runs of about PAIRS_PER_CALL in all."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS_PER_CALL)) + 1
    return list(zip([0, *cuts], [*cuts, len(sizes)]))


def _reach(e: np.ndarray, y: np.ndarray | float) -> np.ndarray:
    """Where edges (x1, y1, x2, y2) are at height y: the operations of ``geometry.edge_crosses`` in their order, which
    rise or fall with y all along, also rounded."""
    x1, y1, x2, y2 = e
    return (x2 - x1) * (y - y1) / (y2 - y1) + x1


def crossings(x: np.ndarray, y: np.ndarray, edges: np.ndarray, layer: int) -> np.ndarray:
    """Edges (x1, y1, x2, y2) that the ray going right from each point crosses; half-open in y."""
    found = np.zeros(len(x), np.int64)
    by_y = np.argsort(y, kind="stable")
    bottom, top = np.minimum(edges[1], edges[3]), np.maximum(edges[1], edges[3])
    for i in range(0, len(x), layer):
        here = by_y[i : i + layer]
        low, high = y[here[0]], y[here[-1]]
        here = here[np.argsort(x[here], kind="stable")]
        xs, ys, counted = x[here], y[here], np.zeros(len(here) + 1, np.int64)
        through = (bottom <= low) & (top > high)
        e = edges[:, through]
        a, b = _reach(e, low), _reach(e, high)
        first, end = np.searchsorted(xs, np.minimum(a, b), "left"), np.searchsorted(xs, np.maximum(a, b), "left")
        # points before the run lie left of all of it and cross, those behind it never do
        counted += np.cumsum(np.bincount(first, minlength=len(here) + 1)[::-1])[::-1]
        counted = np.concatenate((counted[1:], [0]))
        sizes = end - first
        met = np.flatnonzero(sizes)
        for lo, hi in _runs(sizes[met]) if len(met) else ():
            of = np.repeat(met[lo:hi], sizes[met[lo:hi]])
            at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes[met[lo:hi]]) - sizes[met[lo:hi]], sizes[met[lo:hi]])
            counted += np.bincount(at[xs[at] < _reach(e[:, of], ys[at])], minlength=len(here) + 1)
        part = edges[:, ~through & (bottom <= high) & (top > low)]
        step = max(1, PAIRS_PER_CALL // len(here))
        for j in range(0, part.shape[1], step):
            p = part[:, j : j + step, None]
            counted[:-1] += (((p[1] > ys) != (p[3] > ys)) & (xs < _reach(p, ys))).sum(axis=0)
        found[here] += counted[:-1]
    return found


def count_crossings(key: str, layer: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Points (key, id, x, y) and edges of one task to (key, id, x, y, c)."""

    def count(points: pa.Table, sides: pa.Table) -> pa.Table:
        edges = np.stack([sides.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
        c = crossings(points.column("x").to_numpy(), points.column("y").to_numpy(), edges, layer)
        return points.select([key, "id", "x", "y"]).append_column("c", pa.array(c))

    return count
