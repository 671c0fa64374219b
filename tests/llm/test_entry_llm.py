"""The queries of this subpackage run on the smallest data; those with SQL agree with it."""

import os

import pytest

from lodepath.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    import duckdb

    df = Q.QUERIES[name](spark, DATA)
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(map(str, found)))
    if name in Q.ORACLE:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        c = con.execute(Q.ORACLE[name])
        assert [x[0] for x in c.description] == df.columns and sorted(c.fetchall()) == sorted(found)
