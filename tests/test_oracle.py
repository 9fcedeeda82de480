"""Every query of the library outside the training-data subpackage against its SQL."""

import pytest

from compare import DATA, assert_same
from sweepmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, f"{DATA}/sf0.001"), catalog.ORACLE_SQL[name], f"{DATA}/sf0.001")


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
