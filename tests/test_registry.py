"""Every registered query against its SQL."""

from __future__ import annotations

import oracle
import pytest

from terrafold.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_samples_repeat(spark, sf):
    ids = [sorted(r["id"] for r in QUERIES["sample_points_hashed"](spark, sf).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 200


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 19
    assert set(entry.oracle_sql()) <= set(entry.queries())
