"""The registered queries on the smallest tables: against their SQL where there is one."""

from pathlib import Path

import pytest
from compare import compare, connect

from heirloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    sql = queries.oracle_sql().get(name)
    verdict, _, rows, detail = compare(spark, con, name, queries.queries()[name], sql, SF)
    assert verdict == ("ok" if sql else "rows-only"), detail
    counted = {"op9_": "count(*) FROM pages", "op10": "count(*) FROM pages", "op12": "count(DISTINCT conv_id) FROM conversations"}
    assert rows == con.execute(f"SELECT {counted.get(name[:4], 'count(*) FROM documents')}").fetchone()[0]
