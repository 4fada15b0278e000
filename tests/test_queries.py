"""Every registered query of the review engine: the same rows as its SQL, or at least rows."""

from __future__ import annotations

import pytest

from murmurate import registry
from tests.oracle import compare, connect

registry.load()
SF = "/root/testdata/sf0.001"
#: Queries that rightly find nothing in a table this small.
MAY_BE_EMPTY = {"segment_findings", "segment_findings_low"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, con, name):
    compare(spark, con, SF, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
