import pytest

from leafmill.plans import catalog

from .oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
