"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

from lexspan.plans import registry
from tests.conftest import DATA, assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_its_sql(spark, name):
    frame = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLES:
        assert_same(frame, registry.ORACLES[name])
    else:
        frame.collect()


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
