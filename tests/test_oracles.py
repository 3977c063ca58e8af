"""Every registered query against its oracle statement, or for rows and a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference
from tests.conftest import FOLDER, ROWS_FOLDER

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, oracle, key):
    diff, _ = difference(spark, oracle, FOLDER, QUERIES[key], ORACLES[key])
    assert diff is None, diff


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, key):
    df = QUERIES[key](spark, ROWS_FOLDER)
    assert df.columns
    assert df.count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 11
