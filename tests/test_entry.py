"""The driver contract: entry() smoke check and every key against its oracle."""

import pytest
from conftest import SF_SMALL
from oracle_compare import compare, duck

import __spark_entry__ as entry
from perigee.plans import driver

# The library's own keys; those of the training-data operators have tests of their own.
KEYS = sorted(driver.queries())


def test_entry_returns_rows_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["asteroid_name", "closest_astronomical_distance", "closest_approach_date"]
    assert df.count() > 0
    assert entry.entry(spark).schema == df.schema


def test_every_key_has_an_oracle():
    assert set(KEYS) == set(driver.oracle_sql())
    assert set(KEYS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, key):
    r = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF_SMALL)
    assert r["status"] == "ok", r
