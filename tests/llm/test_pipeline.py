"""The pipeline stage by stage against brute force on the stage's own input."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_llm_operators import brute_lines, brute_near, check_packing, water_fill


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, sf), f"test_{name}")
        out.append((docs.collect(), made.collect(), docs.columns, made.columns))
        docs = made
    return out


def test_columns(stages):
    assert all(a == b for _, _, a, b in stages[:-1])


def test_toxicity(spark, stages, sf):
    before, after, *_ = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert all(labels.get(i, 1) for i in gone)
    assert len(after) >= 0.8 * len(before)


def test_toxic_documents_go(spark, sf):
    """The stage drops at least nine of ten documents that are labelled toxic, and nearly no clean one."""
    sf = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(docs.select("doc_id"), "doc_id").collect()
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic = [r["doc_id"] not in kept for r in labels if r["toxic"] == 1]
    clean = [r["doc_id"] not in kept for r in labels if r["toxic"] == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_lines(stages):
    before, after, *_ = stages[1]
    want = {i: t for i, _, n, t in brute_lines([(r["doc_id"], r["text"]) for r in before]) if t.strip(" \t\n\r\x0b\f") or not n}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_copies(stages):
    before, after, *_ = stages[2]
    want = set(brute_near({r["doc_id"]: r["text"] for r in before}).values())
    assert sorted(r["doc_id"] for r in after) == sorted(want)


def test_near_copies_beyond_five_bits(spark, sf):
    """Against all pairs of 0.8 or more, whatever their fingerprints."""
    rng = random.Random(3)
    texts, i = {}, 0
    for size in [60] * 12 + [300] * 12:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for edits in (0, 1, 1 + size // 60):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(size)] = f"edit{rng.randrange(10**6)}"
            texts[i], i = " ".join(copy), i + 1
    whole = set(brute_near(texts, distance=64).values())
    assert len(whole) < len(set(brute_near(texts).values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == whole


def test_mixing(stages):
    before, after, *_ = stages[3]
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    sizes, largest, got = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    for r in after:
        got[r["source"]] += size[r["doc_id"]]
    for s, target in water_fill(sizes, sum(sizes.values())).items():
        assert abs(got[s] - target) <= largest[s]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3


def test_packing(spark, stages, sf):
    before, after, *_ = stages[4]
    used, least = check_packing(after, [(r["doc_id"], r["text"]) for r in before])
    assert used <= least + 1
    assert math.isclose(corpus_pipeline.run(spark, sf).count(), len(after))
