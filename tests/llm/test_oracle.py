import pytest

from tessella.llm import catalog
from tests.support import assert_matches


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert_matches(catalog.queries()[name](spark, sf), sf, catalog.oracle_sql()[name])
