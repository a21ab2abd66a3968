import pytest

import __spark_entry__ as entry
from foldstone.plans import queries
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    oracle.same(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE_SQL[name])


def test_entry_runs_and_every_state_query_has_sql(spark):
    assert entry.entry(spark).columns == ["key", "value", "seq"]
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert set(queries.QUERIES) <= set(entry.queries())
