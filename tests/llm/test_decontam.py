"""Decontamination against brute force, on odd rows and in its three ways of removing."""

from __future__ import annotations

import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from terrafold.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, n=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                if key in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Two three four five SIX seven eight nine ten eleven!"),
    (10, "short item"), (3, ""), (4, None), (None, "no id at all"), (5, "ünï cödé"), (6, "short item"), (6, "another text of six"), (7, "... --- !!"),
]
LONG = " ".join(f"w{i % 313}" for i in range(20_000)) + " short-item " + " ".join(f"v{i}" for i in range(5))
DOCS = [
    (1, "x One two three four five six seven eight nine ten eleven twelve y"), (1, "x One two three four five six seven eight nine ten eleven twelve y"),
    (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, " \t..\n"), (None, "a SHORT, item. and a short item"), (None, None),
    (6, LONG), (7, "short\nitem short"), (8, "no id at all"), (9, "Ünï cödé ünï cödé"), (1, "another text of six words"), (11, "one two" * 40),
]
SCHEMA, ITEM_SCHEMA = "doc_id bigint, text string", "item_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, ITEM_SCHEMA)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [10, 4, 1])
def test_matches_brute_force(docs, items, window):
    assert rows_of(decontam.decontaminate(docs, items, window, None)) == brute(DOCS, ITEMS, window)


def test_random_texts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    some, more = [(i, text(rng.randrange(0, 14))) for i in range(30)], [(i, text(rng.randrange(0, 120))) for i in range(120)]
    got = decontam.decontaminate(spark.createDataFrame(more, SCHEMA), spark.createDataFrame(some, ITEM_SCHEMA), 6, None)
    assert rows_of(got) == brute(more, some, 6)


def test_spans_and_documents_go(docs, items):
    out = decontam.decontaminate(docs, items)
    kept = {r["doc_id"]: r["text"] for r in out.filter("doc_id in (7, 9, 8, 5, 2)").collect()}
    assert kept == {7: " short", 9: "Ünï cödé", 8: "", 5: " \t..\n", 2: DOCS[2][1]}
    assert {r["text"] for r in out.filter("doc_id = 1").collect()} == {"x y", " words"}
    assert out.filter("doc_id = 3").first()["text"] is None and out.filter("doc_id = 6").first()["n_hit"] == 2
    stay = decontam.decontaminate(docs, items, remove="documents")
    assert stay.count() == sum(not b[2] for b in brute(DOCS, ITEMS)) and stay.filter("contaminated").count() == 0


def test_odd_tables(spark, docs, items):
    for names in (docs, docs.withColumn("items", F.lit("mine")).withColumns({c: F.lit("z") for c in ("id", "copy", "row", "hit", "kept", "w", "at", "h", "win", "item")})):
        out = decontam.decontaminate(names, items)
        assert out.count() == len(DOCS) and out.columns[: len(names.columns)] == names.columns
        assert len(out.columns) == len(set(out.columns)) and out.filter("doc_id = 7").first()["items"] == ["10", "6"]
    none = spark.createDataFrame([], ITEM_SCHEMA)
    assert decontam.decontaminate(docs, none).filter("contaminated").count() == 0
    assert decontam.decontaminate(docs, none).count() == len(DOCS)
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def test_few_windows_are_broadcast_and_many_joined(spark, docs, items, monkeypatch):
    windows = decontam.item_windows(items)
    known = windows.select("len", "h", F.lit(1).alias("w1"), F.lit(2).alias("w2"))
    plan = plan_of(decontam._candidates(docs, known, [2, 10]))
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    from terrafold.plans import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    assert rows_of(decontam.decontaminate(docs, items, remove=None)) == brute(DOCS, ITEMS)


def test_a_hot_passage(spark):
    """A third of all documents hold one item, which many items repeat."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}" if i % 3 == 0 else f"c{i} d{i}") for i in range(3000)], SCHEMA)
    items = spark.createDataFrame([(i, passage) for i in range(20)], ITEM_SCHEMA)
    got = decontam.decontaminate(docs, items)
    assert got.filter("contaminated").agg(F.sum("n_hit"), F.min("n_items"), F.count("*")).first() == (40_000, 20, 1000)
