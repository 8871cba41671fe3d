"""The near-copy search of the pipeline: bands, chains and hot keys, against all pairs."""

from __future__ import annotations

import functools
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from terrafold.llm import simhash
from test_llm_operators import brute_near


def all_near(sets, similarity=0.8):
    """Smallest id of the group of every id, by all pairs of shingle sets that share a rare enough shingle; exact."""
    seen = Counter(h for s in sets.values() for h in s.tolist())
    parent, index = {i: i for i in sets}, defaultdict(list)

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in sorted(sets):
        rare = sorted(sets[i].tolist(), key=lambda h: (seen[h], h))
        rare = rare[: len(rare) - math.ceil(similarity * len(rare)) + 1]
        for j in {j for h in rare for j in index[h]}:
            if top(i) != top(j):
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                    parent[max(top(i), top(j))] = min(top(i), top(j))
        for h in rare:
            index[h].append(i)
    return {i: top(i) for i in sets}


def test_chains_lose_no_pair_and_report_it_once():
    rng = np.random.default_rng(5)
    diff = np.zeros(4000, dtype=np.uint64)
    for i in range(len(diff)):
        for bit in rng.choice(64, size=rng.integers(0, 20), replace=False):
            diff[i] ^= np.uint64(1) << np.uint64(bit)
    for distance in (2, 5, 11):
        viable = np.array([simhash.chain_viable(diff, s, distance) for s in range(simhash.RING)])
        assert (viable.any(axis=0) == (np.bitwise_count(diff) <= distance)).all()


def test_ring_within_is_the_full_check_in_spark(spark):
    rng = random.Random(6)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rows = []
    for _ in range(500):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 20)):
            b ^= 1 << bit
        rows.append((signed(a), signed(b), (a ^ b).bit_count() <= 11))
    df = spark.createDataFrame(rows, "a bigint, b bigint, want boolean")
    assert df.filter(simhash.ring_within("a", "b", 11) != df.want).count() == 0


def test_band_keys():
    rng = np.random.default_rng(9)
    empty = simhash.band_keys(np.empty(0, dtype=np.int64))
    assert len(set(empty)) == simhash.BANDS and empty == simhash.band_keys(np.empty(0, dtype=np.int64))
    met = 0
    for _ in range(300):
        shared, a, b = (rng.integers(-(2**63), 2**63 - 1, size=n) for n in (1600, 200, 200))
        met += bool(set(simhash.band_keys(np.append(shared, a))) & set(simhash.band_keys(np.append(b, shared))))
    assert met >= 0.97 * 300  # sets that share 0.8; 0.995 expected


def test_hot_keys_in_blocks(spark, monkeypatch):
    """Every key goes the way of hot keys, in blocks of a few texts: one large group of edited copies, and others."""
    rng = random.Random(11)
    texts, i = {}, 0
    for size, copies in ((80, 60), (40, 10), (3, 4), (0, 3)):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for k in range(copies):
            copy = base[:]
            if size:
                copy[rng.randrange(size)] = f"edit{k % 7}"
            texts[i], i = " " * (k if not size else 0) + " ".join(copy), i + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    near = {"distance": simhash.WIDE_DISTANCE, "similarity": simhash.NEAR_SIMILARITY}
    plain = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, **near).collect()}
    monkeypatch.setattr(simhash, "NODES_PER_BLOCK", 4)
    monkeypatch.setattr(simhash, "similar_roots", functools.partial(simhash.similar_roots, key_rows=1))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, **near).collect()} == plain
    assert plain == brute_near(texts, distance=simhash.WIDE_DISTANCE)


def test_recall_on_documents(spark, sf):
    """On whole texts, and on what the line stage leaves: at least 0.95 of the documents that all pairs drop go, and no others."""
    sf = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for some in (docs, corpus_pipeline.written(corpus_pipeline.drop_shared_lines(spark, docs, sf), "near_test")):
        texts = {r["doc_id"]: r["text"] for r in some.collect()}
        want = all_near({i: simhash.shingle_set(t) for i, t in texts.items()})
        gone = set(texts) - {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, some, sf).select("doc_id").collect()}
        least = {i for i, top in want.items() if i != top}
        assert gone <= least and len(gone) >= 0.95 * len(least)
