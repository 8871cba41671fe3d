"""The prefix trie against a plain trie, over several blocks and levels, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")


def sequences(rows, rebuild=True):
    md5 = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def conversations(n, seed, texts="abc", longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        stem = rng.choice([[], ["hello"], ["hello", "go on"]])
        for i, t in enumerate(stem + [rng.choice(texts) * rng.randrange(1, 4) for _ in range(rng.randrange(0, longest))]):
            rows.append((c, i, "user" if i % 2 else "bot", t))
    return rows


def trie(spark, rows, rebuild=True, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    turns = prefixes.conversation_turns(df)
    ids = df.select("conv_id").filter("conv_id IS NOT NULL")
    if rebuild:
        turns, ids = prefixes.with_borrowed_heads(turns)
    return sorted((tuple(r[c] for c in NAMES) for r in prefixes.prefix_trie(turns, ids, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"rows_per_block": 7}, {"step": 2}, {"step": 3, "rows_per_block": 5}])
@pytest.mark.parametrize("rebuild", [True, False])
def test_matches_a_plain_trie(spark, how, rebuild):
    rows = conversations(150, 3)
    assert trie(spark, rows, rebuild, **how) == brute(sequences(rows, rebuild))


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "a"), (0, 0, None, None), (0, None, "user", "first"), (0, 1, "user", "a"), (0, 1, "bot", "a"),
        (1, 5, "user", "x"), (None, 0, "user", "lost"), (2, 0, "us", "er text"), (3, 0, "user", " text"), (4, 0, "", "ü" * 50_000), (-7, 0, "user", "negative"),
        (5, 0, "user", "first"), (12, 3, "user", None), (13, 3, None, ""), (10, 0, None, None),
    ]
    for rebuild in (True, False):
        assert trie(spark, rows, rebuild) == brute(sequences(rows, rebuild))
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "lost")]) == []
    mute = spark.createDataFrame([(4,), (9,), (9,)], "conv_id bigint")
    none = prefixes.conversation_turns(spark.createDataFrame([], SCHEMA))
    (root,) = prefixes.prefix_trie(none, mute).collect()
    assert (root["conv_id"], root["n_convs"], root["n_leaves"], root["ends_sha256"]) == (4, 2, 1, hashlib.sha256(b"4,9").hexdigest())


def test_extra_columns_do_not_clash(spark):
    rows = conversations(40, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("pos", "size", "no", "level", "path", "node")})
    got = prefixes.conversation_turns(df)
    assert got.columns == ["conv_id", "pos", "turn", "size"] and got.count() == len(rows)


def test_a_long_conversation_and_a_hot_copy(spark, monkeypatch):
    """One conversation holds a third of all rows, another third are copies of one; ids run over several lists."""
    monkeypatch.setattr(prefixes, "IDS_PER_LIST", 50)
    rows = [(0, i, "user", f"turn {i % 40}") for i in range(1200)] + [(5 * c, i, "user", f"turn {i}") for c in range(1, 300) for i in range(4)]
    rows += conversations(100, 9, longest=5)[:400]
    rows = [(c + (7 if i >= 2396 else 0), t, r, x) for i, (c, t, r, x) in enumerate(rows)]
    assert trie(spark, rows, False, step=100, rows_per_block=20) == brute(sequences(rows, False))


def test_extents_by_range_minima():
    rng = np.random.default_rng(1)
    lcp = rng.integers(0, 5, 200)
    lcp[0] = -1
    at, depth = rng.integers(0, 200, 2000), rng.integers(0, 6, 2000)
    left, right = prefixes.extents(lcp, at, depth)
    for i, d, lo, hi in zip(at, depth, left, right):
        a = b = i
        while a > 0 and lcp[a] >= d:
            a -= 1
        while b + 1 < 200 and lcp[b + 1] >= d:
            b += 1
        assert (a, b) == (lo, hi)
    low, high = np.minimum(at, left), right
    assert (prefixes.range_min(prefixes.sparse_minima(lcp), low, high) == [lcp[a : b + 1].min() for a, b in zip(low, high)]).all()
