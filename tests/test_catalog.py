"""Every query against DuckDB on the smallest tables; those without SQL must run and keep their columns."""

import oracle
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
    else:
        assert oracle.differences(df, sql, con) == []
