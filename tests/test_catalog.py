import pytest
from oracle import same

from loomgrid.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    same(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir)


def test_entry_has_rows(spark, sf_dir):
    assert catalog.QUERIES["fcf_graph"](spark, sf_dir).count() > 0
