"""Exact top-k search by vector approximations: quantised cells bound the scores, exact vectors settle them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.plans.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
SCALE = 256
CELL_BITS = 6
ROWS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 2_048
READ = 32
EXACT_FLOAT = 2**52
LONG = 2**63 - 1


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, v) with v = floor(scale * x) as exact doubles and rid a number of the row's own; write the
    table before using it twice. Vectors that are null or hold a null or non-finite component take no part, nor do
    rows without an id. Rows that repeat an id are rows of their own."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    good = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(x, lambda e: _floor(e.cast("double") * scale))
    return good.select(F.monotonically_increasing_id().alias("rid"), "vec_id", v.alias("v"))


def _floor(d):
    """floor as a double; beyond 2^53 every double is whole already, and a long could not hold it."""
    return F.when(F.abs(d) < F.lit(float(2**53)), F.floor(d).cast("double")).otherwise(d)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _exact(rows: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products; Python integers where doubles could round, kept within a long."""
    if small:
        return (rows @ q).astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(r, q)))) for r in rows], dtype=np.int64)


def search_block(rids, ids, rows, query_rids, query_ids, queries, k: int, low: float, step: float, read: int = READ) -> list[tuple]:
    """The ``k`` best rows of one block for each query, its own row left out, as (query_rid, query_id, vec_id, score).

    Each component is known by its cell only: its middle, and at most half a cell beside it. The product with
    the middles, plus or minus half a cell times the query's absolute sum, bounds a score. Rows are read
    exactly in the order of their upper bounds until the k-th exact score is above all bounds that are left.
    """
    codes = np.floor((rows - low) / step).astype(np.uint16)
    middles = low + (codes + 0.5) * step
    size = np.abs(rows).max(initial=0.0) * np.abs(queries).max(initial=0.0) * rows.shape[1]
    small = size < EXACT_FLOAT
    about = queries @ middles.T
    slack = np.abs(queries).sum(axis=1) * step / 2 + 1e-9 * size + 1e-6
    out = []
    for i, (query_rid, query_id) in enumerate(zip(query_rids, query_ids)):
        upper = about[i] + slack[i]
        upper[rids == query_rid] = -np.inf
        n = len(ids) - int((rids == query_rid).sum())
        if not n:
            continue
        kth = np.partition(about[i] - slack[i] if n == len(ids) else np.where(np.isinf(upper), -np.inf, about[i] - slack[i]), -min(k, n))[-min(k, n)]
        near = np.flatnonzero((upper >= kth) & ~np.isinf(upper))
        near = near[np.argsort(-upper[near], kind="stable")]
        best: list[tuple[int, int]] = []
        for lo in range(0, len(near), read):
            if len(best) == k and upper[near[lo]] < -best[-1][0]:
                break
            some = near[lo : lo + read]
            exact = _exact(rows[some], queries[i], small)
            best = sorted(best + [(-int(s), int(v)) for s, v in zip(exact, ids[some])])[:k]
        out += [(int(query_rid), int(query_id), v, -s) for s, v in best]
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = 50, scale: int = SCALE, cell_bits: int = CELL_BITS,
          rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` highest integer inner products over all other rows.

    Queries are the rows whose vec_id is divisible by ``every``; rows that repeat an id are a query each, and candidates
    of one another. Both sides are cut into blocks of bounded size
    at random, and each pair of a query block with a row block of the same vector length is one group; what
    comes out is k rows per query and block. Ties go to the smaller vec_id. Vectors are compared with vectors
    of their own length. Scores outside the range of a long are kept at its ends.
    """
    table = written(integer_vectors(vectors, scale).withColumn("dim", F.size("v")).filter("dim > 0"), "vectors")
    shape = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"),
        F.min(F.array_min("v")).alias("low"),
        F.max(F.array_max("v")).alias("high"),
    ).first()
    low = float(shape["low"] or 0.0)
    step = max(1.0, (float(shape["high"] or 0.0) - low + 1) / 2**cell_bits)
    blocks = max(1, -(-shape["n"] // rows_per_block))
    query_blocks = max(1, -(-shape["q"] // queries_per_block))
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("rid")), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = table.select("dim", "rid", "vec_id", "v", own(blocks, 1).alias("rb")).select("*", all_of(query_blocks).alias("qb"))
    asked = table.filter(F.col("vec_id") % every == 0).select("dim", "rid", "vec_id", "v", own(query_blocks, 2).alias("qb")).select("*", all_of(blocks).alias("rb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = search_block(
                *[left.column(c).to_numpy() for c in ("rid", "vec_id")], _matrix(left),
                *[right.column(c).to_numpy() for c in ("rid", "vec_id")], _matrix(right), k, low, step,
            )
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.table([pa.array(c, type=pa.int64()) for c in columns], names=["query_rid", "query_id", "vec_id", "score"])

    keys = ["rb", "qb", "dim"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_rid bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_rid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
