"""Every named query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from check import compare
from webloom.registry import catalog

QUERIES, CHECKS = catalog.QUERIES, catalog.CHECKS


def test_all_have_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    outcome = compare(spark, "/root/testdata/sf0.001", QUERIES[name], CHECKS.get(name))
    assert outcome.startswith("ok"), outcome
    assert not outcome.endswith(" 0")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["site", "source", "destination", "anchor_text", "status_code"] and df.count() > 0
