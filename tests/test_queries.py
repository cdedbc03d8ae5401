"""Every query with SQL against DuckDB; the others give rows."""

import pytest
from conftest import SF

from pagewright.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, compare):
    compare(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
