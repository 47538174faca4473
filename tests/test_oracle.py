"""Every query against its SQL, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from tessera import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*Q.QUERIES])
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    rel = con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    plain = lambda v: int(v) if isinstance(v, Decimal) and v == int(v) else v
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in sorted(rel.columns)) for r in rel.fetchall()), key=repr)
    assert got == want
