"""The operators that SQL can express, row by row against DuckDB over whole test tables."""

import pytest
from helpers import SF, SF_MID
from oracle_compare import compare, duck

from perigee.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", [SF, SF_MID])
@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_operator_matches_sql(spark, key, sf):
    r = compare(spark, duck(sf), key, QUERIES[key], ORACLE_SQL[key], sf)
    assert r["status"] == "ok", r
