"""Every catalog query against its SQL on the smallest tables."""

import pytest
from checker import compare

import __spark_entry__ as entry_points
from plotgrid.plans.catalog import CHECKS, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in CHECKS:
        assert compare(frame, duck, CHECKS[name]) is None
    else:
        assert frame.count() >= 0


def test_entry_points(spark):
    assert entry_points.entry(spark).columns == ["region", "building_count"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
