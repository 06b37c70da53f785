"""All queries of the rule library: their SQL gives the same rows; those without SQL give some."""

import pytest
from oracle import rows_of, rows_of_sql

from rulewright.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    names, rows = rows_of(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert (names, rows) == rows_of_sql(ORACLES[name], sf_dir)
    else:
        assert rows
