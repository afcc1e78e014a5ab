"""Every registered query against its SQL oracle on the given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference
from workload.oracles import ORACLES as OWN_ORACLES
from workload.queries import QUERIES

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(OWN_ORACLES)
    assert set(ORACLES) <= set(queries())


def test_entry_returns_rows(spark):
    df = entry(spark)
    assert df.columns == ["window_start", "window_end", "song_id", "name", "genre", "play_count"]
    assert df.count() == 289


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, oracle, name):
    assert difference(queries()[name](spark, sf_dir), oracle, ORACLES[name]) is None
