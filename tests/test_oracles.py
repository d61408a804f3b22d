"""Every query with SQL gives in Spark what DuckDB gives; the others run and have rows."""

import pytest
from conftest import DATA

import oracle
from eventloom.plans.catalog import ORACLES, QUERIES


#: Queries without SQL whose result can rightly be empty on the smallest tables.
MAY_BE_EMPTY = {"merge_candidates_fuzzy"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert oracle.difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() >= (0 if name in MAY_BE_EMPTY else 1)
