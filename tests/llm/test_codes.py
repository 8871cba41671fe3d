"""Vector codes against plain rounds without bounds, on odd rows and large components."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, scale=1024, parts=4, entries=256, rounds=4):
    """{row number: (codes, error)} and the books of one vector length, in Python integers."""
    good = [(i, vec_id, [math.floor(scale * x) for x in e]) for i, (vec_id, e, _) in enumerate(rows)
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(good, key=lambda g: (g[1] is None, g[1] or 0, g[2]))[:entries]
    dim = len(good[0][2])
    span = [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]
    books = [[g[2][a:b] for g in first] for a, b in span]
    far = lambda x, y: sum((s - t) ** 2 for s, t in zip(x, y))
    for step in range(rounds + 1):
        out = {i: ([], 0) for i, *_ in good}
        for p, (a, b) in enumerate(span):
            held = [[] for _ in books[p]]
            for i, _, v in good:
                best = min(range(len(books[p])), key=lambda k: (far(v[a:b], books[p][k]), k))
                held[best].append(v[a:b])
                out[i] = ([*out[i][0], best], out[i][1] + far(v[a:b], books[p][best]))
            if step < rounds:
                books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    return out, books


def check(spark, rows, **how):
    got = codes.compress(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", no int").repartition(3), **how)
    want, books = brute(rows, **how)
    assert {r["no"]: (list(r["code"]), r["error"]) for r in got.rows.collect()} == {i: (c, min(e, 2**63 - 1)) for i, (c, e) in want.items()}
    (mine,) = got.books.values()
    assert [[[int(x) for x in e] for e in b] for b in mine] == books
    return got


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [c + spread * rng.gauss(0, 0.2) for c in rng.choice(centres)], i % 3) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"entries": 7, "rounds": 6}, {"scale": 3, "entries": 20}, {"entries": 1}, {"rounds": 0}])
def test_matches_rounds_without_bounds(spark, how):
    check(spark, vectors(300, 8, 1), **how)


def test_odd_rows(spark):
    rows = vectors(40, 8, 2) + [
        (3, vectors(1, 8, 5)[0][1], None), (None, vectors(1, 8, 6)[0][1], None), (50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [math.nan] * 8, 1),
        (53, [math.inf] + [0.0] * 7, 1), (54, [0.0] * 8, None), (54, [0.0] * 8, None),
    ]
    check(spark, rows, entries=6)
    check(spark, [(1, [1e30, -1e30, 5.0, 1e20], 1), (2, [1e30, 1e30, 5.5, 3.0], 1), (3, [7.0, 1.0, -2.0, 1e20], 2)], entries=2, scale=2)
    check(spark, [(i, [float(i % 3)] * 6, 0) for i in range(9)], entries=4)  # parts of unequal width, ties
    none = codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.rows.count() == 0 and none.rows.columns == ["vec_id", "embedding", "label", "code", "error", "codebooks_sha256"]
    mixed = spark.createDataFrame(vectors(20, 8, 3) + vectors(10, 4, 4) + [(99, [], 1)], SCHEMA)
    out = codes.compress(mixed, entries=5)
    assert out.rows.count() == 31 and sorted(out.books) == [0, 4, 8] and out.rows.filter("vec_id = 99").first()["error"] == 0


def test_clash_labels_and_decoding(spark):
    rows = vectors(60, 8, 7)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("row", "v", "bound", "stamp", "kind", "part", "n", "approx")})
    df = df.withColumn("label", F.when(F.col("label") > 0, F.col("label")))
    out = codes.compress(df, entries=16)
    assert out.rows.columns == [*df.columns, "code", "error", "codebooks_sha256"]
    sums = codes.label_errors(out.rows).collect()
    for r in sums:
        assert r["label_error"] == sum(s["error"] for s in sums if s["label"] == r["label"])
    for r in out.decoded().collect():
        whole = [math.floor(1024 * x) for x in r["embedding"]]
        assert r["v"] == "mine" and sum((a - 1024 * b) ** 2 for a, b in zip(whole, r["approx"])) == pytest.approx(r["error"])


def test_bounds_settle_rows_and_never_lie():
    """Later rounds leave most rows unscanned, net moves are below summed moves, and codes equal full scans."""
    rows = np.floor(np.array([v for _, v, _ in vectors(3000, 16, 8, 0.4)]) * 1024)
    history = [rows[:12].copy()]
    plain = lambda book: np.argmin(((rows[:, None, :] - book[None]) ** 2).sum(axis=2), axis=1)
    state = None
    for _ in range(8):
        a = codes.Assigner(list(history))
        state = a.first(rows) if state is None else a.again(rows, *state)
        assert (state[0] == plain(history[-1])).all() and a.scanned + a.skipped == len(rows)
        book = history[-1].copy()
        for k in np.unique(state[0]):
            book[k] = np.floor(rows[state[0] == k].sum(axis=0) / (state[0] == k).sum())
        history.append(book)
    assert a.skipped > 0.7 * len(rows) and len(set(state[2].tolist())) > 1
    steps = sum(codes.displacement(x, y) for x, y in zip(history, history[1:]))
    net = codes.displacement(history[0], history[-1])
    assert (net <= steps + 1e-6).all() and net.sum() < steps.sum()
