"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

from quillstack import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(plans.ORACLES[name])
    told = [c[0] for c in cursor.description]
    assert sorted(told) == columns
    want = sorted((tuple(rounded(r[told.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr) == want
