"""The queries against their SQL, over whole tables."""

import pytest
from oracle_check import connection, differences

from seapoint.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = connection(SF)
    expected = con.sql(queries.oracle_sql()[name]).df()
    rows = queries.queries()[name](spark, SF)
    assert set(rows.columns) == set(expected.columns)
    assert differences(rows.toPandas(), expected) == ""
    con.close()
