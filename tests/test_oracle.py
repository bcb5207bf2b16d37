"""Every registered query against its SQL statement on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from orderloom.plans import oracle, registry
from tests.compare import duck, oracle_rows, spark_rows

QUERIES, ORACLES = registry.registered(), oracle.statements()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_the_headline_row(spark, sf_dir):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf_dir, con, key):
    columns, rows = spark_rows(QUERIES[key](spark, sf_dir))
    if key not in ORACLES:
        assert rows
        return
    want_columns, want = oracle_rows(con, ORACLES[key])
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("key", ["core_null_profile", "core_schema_profile", "core_sample_rows"])
def test_profiles_cover_the_core_tables(spark, sf_dir, key):
    rows = QUERIES[key](spark, sf_dir).select("table_name").distinct().collect()
    assert {r[0] for r in rows} == set(registry.CORE)
