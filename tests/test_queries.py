"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

from heirloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_equivalent():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    sql = catalogue.oracle_sql().get(name)
    verdict, _, _, detail = compare(spark, con, name, catalogue.queries()[name], sql, SF)
    assert verdict in ("ok", "rows-only"), detail
